"""Text predicates and extractions. Ids P30, P32-P36 of the survey."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What a content audit looks for. A text has an issue if any of its patterns is found.
ISSUES = {
    "cjk": (r"[\x{3040}-\x{30ff}\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}\x{ac00}-\x{d7af}]",),
    "email": (r"(?i)\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}\b",),
    "home_path": (r"(?i)\b[A-Z]:[\\/](?:Users|Documents and Settings)[\\/][^\\/\s]+", r"/(?:Users|home)/[^/\s]+"),
    "private_key": (r"-----BEGIN (?:RSA |EC |OPENSSH )?PRIVATE KEY-----",),
    "token": (r"AKIA[0-9A-Z]{16}", r"gh[pousr]_[A-Za-z0-9_]{20,}", r"github_pat_[A-Za-z0-9_]{20,}", r"sk-[A-Za-z0-9_-]{20,}"),
}
#: Names, endings and folders that an audit of published files rejects, and the bytes that a file may have.
BAD_NAMES = (".env", "credentials.json", "id_rsa", "id_ed25519")
BAD_ENDINGS = (".ckpt", ".h5", ".hdf5", ".key", ".npy", ".npz", ".onnx", ".pem", ".pickle", ".pkl", ".pt", ".pth")
BAD_FOLDERS = (".pytest_cache", ".ruff_cache", "__pycache__", "checkpoints", "datasets", "outputs", "runs", "secrets", "wandb")
MOST_BYTES = 1 << 20


def _named(tests: dict[str, Column]) -> Column:
    """The names of the tests that hold."""
    return F.filter(F.array(*(F.when(test, F.lit(n)) for n, test in tests.items())), lambda x: x.isNotNull())


def issues(text: Column) -> Column:
    """Names of the issues found in a text. P30."""
    return _named({n: reduce(lambda a, b: a | b, (text.rlike(p) for p in found)) for n, found in ISSUES.items()})


def file_issues(path: Column, content: Column) -> Column:
    """Names of a file's issues: of its path, below the audited root, of its size and of its bytes. Binary files and files that
    aren't UTF-8 are not searched any further. P31."""
    parts = F.split(F.lower(path), "/")
    name = F.element_at(parts, -1)
    # an ending is what follows the last dot of a name that neither begins nor ends with that dot
    ending = F.regexp_extract(name, r"[^.].*?(\.[^.]+)$", 1)
    binary = F.position(F.lit(b"\0"), content) > 0
    text = F.try_validate_utf8(content.cast("string"))
    outer = _named({
        "name": name.isin(*BAD_NAMES), "ending": ending.isin(*BAD_ENDINGS), "folder": F.arrays_overlap(parts, F.array(*map(F.lit, BAD_FOLDERS))),
        "size": F.octet_length(content) > MOST_BYTES, "binary": binary, "not_utf8": ~binary & text.isNull(),
    })
    return F.concat(outer, F.when(~binary & text.isNotNull(), issues(text)).otherwise(F.array().cast("array<string>")))


def history_issues(commit_log: DataFrame, as_of: str, domain: str = "@users.noreply.github.com") -> DataFrame:
    """(commit, issue) of a log from ``scans.framed_log``: records that don't parse, addresses outside ``domain``, author dates
    after ``as_of``, blank names. S29, P36."""
    odd = lambda c: F.coalesce(~F.lower(c).endswith(domain), F.lit(True))
    blank = lambda c: F.coalesce(F.trim(c) == "", F.lit(True))
    found = F.when(~F.col("whole"), F.array(F.lit("unparseable"))).otherwise(_named({
        "author_email": odd("author_email"), "committer_email": odd("committer_email"),
        "author_date": F.coalesce(written_date(F.col("authored_at")) > F.to_date(F.lit(as_of)), F.lit(True)), "name": blank("author_name") | blank("committer_name"),
    }))
    return commit_log.select(F.when(F.col("whole"), F.col("commit")).otherwise("unknown").alias("commit"), F.explode(found).alias("issue"))


def citation_keys(text: Column) -> Column:
    """Distinct keys of ``[@a; @b]`` groups, sorted. P32."""
    groups = F.regexp_extract_all(text, F.lit(r"\[(@[^\]]+)\]"), F.lit(1))
    keys = F.flatten(F.transform(groups, lambda g: F.regexp_extract_all(g, F.lit(r"@([A-Za-z0-9_:-]+)"), F.lit(1))))
    return F.array_sort(F.array_distinct(keys))


def entries(text: Column) -> Column:
    """Blocks that start with ``@type{key,`` at a line's start. P33."""
    return F.filter(F.split(text, r"(?m)(?=^@[a-zA-Z]+\{)"), lambda x: x.rlike(r"^@[a-zA-Z]+\{"))


def line_of(text: Column, needle: Column) -> Column:
    """Line number of the first find, null without one. P34."""
    at = F.position(needle, text)
    return F.when(at > 0, F.size(F.split(F.left(text, at - 1), "\n")))


def written_date(stamp: Column) -> Column:
    """The date that a time stamp spells out, whatever its offset. P36."""
    return F.to_date(F.substring(stamp, 1, 10))


def after(date: Column, cutoff: str) -> Column:
    """Strictly after the cut-off. P35."""
    return F.to_date(date) > F.to_date(F.lit(cutoff))
