"""Operations for building training corpora, as Spark jobs over whole tables.

Nothing outside this subpackage imports it; its queries are in ``queries``.
"""
