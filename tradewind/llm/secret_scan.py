"""Secrets, told from copied examples by how many owners and repositories have them."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tradewind.llm.common import add_columns, stored, texts

# The base kinds in their order, with their patterns.
BASE_KINDS = ("assign", "access", "hex")
_ASSIGN = re.compile(r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(r"[0-9a-f]{24,}")

# Kinds beyond the base, after them in the order of spans.
MORE_KINDS = ("vendor", "jwt", "private_key", "url_login")
_VENDOR = re.compile(r"(?<![A-Za-z0-9_])(?:xox[abprs]-[A-Za-z0-9-]{10,}+|(?:gh[pousr]_[A-Za-z0-9]{36,}+|sk_live_[A-Za-z0-9]{16,}+|AIza[A-Za-z0-9_-]{35})(?![A-Za-z0-9_]))")
_JWT = re.compile(r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}+\.eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+")
_KEY_HEAD = re.compile(r"-----BEGIN (?:[A-Z]+ )?PRIVATE KEY-----")
_KEY_END = re.compile(r"-----END (?:[A-Z]+ )?PRIVATE KEY-----")
# What follows a header without an END line: base64 pieces, the last one short if its length is right for base64.
_BREAK = r"(?:\s|\\[nr])"  # also line breaks as they are written in source code
_KEY_RUN = re.compile(rf"(?:{_BREAK}*+(?:Proc-Type|DEK-Info):[^\n\\]*+)*+(?:{_BREAK}*+[A-Za-z0-9+/]{{16,}}+={{0,2}}+)*+"
                      rf"(?:{_BREAK}++(?:[A-Za-z0-9+/]{{4}}){{0,3}}(?:[A-Za-z0-9+/]{{2}}==|[A-Za-z0-9+/]{{3}}=|[A-Za-z0-9+/]{{4}})(?={_BREAK}*+(?:\n|\Z)))?")
_KEY_BREAKS = re.compile(_BREAK + "+")
_LOGIN = re.compile(r"://[A-Za-z0-9._~%-]++:([^\s/@:]{6,}+)@")
_RANK = {kind: i for i, kind in enumerate((*BASE_KINDS, *MORE_KINDS))}
# Key bodies are long enough to hold any four letters by chance.
_KEY_PLACEHOLDER = re.compile(r"example|sample|changeme|dummy|placeholder|your[_-]|x{8}|1234567|abcdef|(?<![a-z0-9])test(?![a-z0-9])", re.IGNORECASE)
_PLACEHOLDER = re.compile(r"example|sample|changeme|dummy|placeholder|your[_-]|xxxx|test|1234567|abcdef", re.IGNORECASE)


def entropy(value: str) -> float:
    """Bits per character."""
    return -sum(n / len(value) * math.log2(n / len(value)) for n in Counter(value).values()) if value else 0.0


def key_blocks(text: str) -> list[tuple[int, int, str]]:
    """(start, end, body) of private keys: from the header to the END line, or to the end of the base64 where the text
    ends or the next key starts before one."""
    heads, ends, out = list(_KEY_HEAD.finditer(text)), list(_KEY_END.finditer(text)), []
    limits, at = [*(m.start() for m in heads[1:]), len(text)], 0
    for head, limit in zip(heads, limits):
        while at < len(ends) and ends[at].start() < head.end():
            at += 1
        if at < len(ends) and ends[at].start() < limit:
            body, end = text[head.end():ends[at].start()], ends[at].end()
        else:
            run = _KEY_RUN.match(text, head.end(), limit)
            body, end = run[0], run.end()
        out.append((head.start(), end, body))
    return out


def same_secret(kind: str, value: str) -> str:
    """What copies of a secret have in common: of a private key the body without its line breaks."""
    return _KEY_BREAKS.sub("", value) if kind == "private_key" else value


def is_placeholder(kind: str, value: str) -> bool:
    return bool((_KEY_PLACEHOLDER if kind == "private_key" else _PLACEHOLDER).search(value))


def candidates(text: str | None) -> list[tuple[str, int, int, str]]:
    """(kind, start, end, secret itself) by start, then kind; code points, end exclusive."""
    if not text:
        return []
    found = [("assign", m.start(), m.end(), m[1]) for m in _ASSIGN.finditer(text) if len(m[1]) >= 6]
    found += [("hex", m.start(), m.end(), m[0]) for m in _HEX.finditer(text)]
    if "AKIA" in text:
        found += [("access", m.start(), m.end(), m[0]) for m in _ACCESS.finditer(text)]
    found += [("vendor", m.start(), m.end(), m[0]) for m in _VENDOR.finditer(text)]
    if "eyJ" in text:
        found += [("jwt", m.start(), m.end(), m[0]) for m in _JWT.finditer(text)]
    if "-----BEGIN " in text:
        found += [("private_key", *block) for block in key_blocks(text)]
    if "://" in text:
        found += [("url_login", m.start(1), m.end(1), m[1]) for m in _LOGIN.finditer(text)]
    return sorted(found, key=lambda s: (s[1], _RANK[s[0]]))


_CANDIDATE = T.ArrayType(T.StructType([
    T.StructField("start", T.LongType()), T.StructField("rank", T.IntegerType()), T.StructField("kind", T.StringType()),
    T.StructField("end", T.LongType()), T.StructField("secret", T.StringType()), T.StructField("strength", T.DoubleType()),
    T.StructField("placeholder", T.BooleanType())]))
_CANDIDATE_ARROW = pa.list_(pa.struct([
    ("start", pa.int64()), ("rank", pa.int32()), ("kind", pa.string()), ("end", pa.int64()), ("secret", pa.string()),
    ("strength", pa.float64()), ("placeholder", pa.bool_())]))


def scan_texts(df: DataFrame, text_col: str) -> DataFrame:
    """The input with `_found`: candidates whose secret is a SHA-256, never the text itself."""
    def step(batch: pa.RecordBatch) -> list[pa.Array]:
        rows = [[{"start": s, "rank": _RANK[kind], "kind": kind, "end": e,
                  "secret": hashlib.sha256(same_secret(kind, value).encode("utf-8", "surrogatepass")).hexdigest(),
                  "strength": round(entropy(same_secret(kind, value)), 6), "placeholder": is_placeholder(kind, value)}
                 for kind, s, e, value in candidates(t)] for t in texts(batch, text_col)]
        return [pa.array(rows, _CANDIDATE_ARROW)]

    return add_columns(df, [T.StructField("_found", _CANDIDATE)], step)


def ownership(found: DataFrame) -> DataFrame:
    """`secret`, `owners`, `repos`: distinct counts as two levels of grouping, so that no key meets in one task."""
    places = found.groupBy("secret", "owner", "repo").agg(F.count("*").alias("rows"))
    by_owner = places.groupBy("secret", "owner").agg(F.count("*").alias("repos"))
    return by_owner.groupBy("secret").agg(F.count("*").alias("owners"), F.sum("repos").alias("repos"))


EXAMPLE_REPOS = 100  # distinct repositories that make an example even within one owner


def find_secrets(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source",
                 repo_col: str | None = None, example_owners: int = 3, min_entropy: float = 3.0,
                 example_repos: int = EXAMPLE_REPOS) -> DataFrame:
    """One row per input row: id and `secret_spans` (start, kind, end, base, owners, repos, verdict).

    The verdict of a candidate follows from the whole corpus: `example` if at least `example_owners` distinct
    owners or `example_repos` distinct repositories have the same secret, or if it holds a placeholder word; `live`
    if one owner alone has it and its characters have `min_entropy` bits; `unclear` otherwise. Base kinds are always listed; further kinds only
    if they are not examples. An owner or repository that is NULL is one like any other; without `repo_col`
    each row is a repository of its own. NULL and empty texts have no spans, an empty table gives an empty
    result, a repeated row adds no owner. Only the id is passed on, so extra columns cannot clash.

    Texts are read once; what is kept of them are the candidates with hashed secrets. A secret that a third
    of the rows have is counted after partial grouping, and the adaptive join splits its rows.
    """
    repo = F.col(f"`{repo_col}`") if repo_col else F.col(f"`{id_col}`").cast("string")
    rows = scan_texts(df.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{owner_col}`").alias("_owner"),
                                repo.alias("_repo"), F.col(f"`{text_col}`").alias("_text")), "_text")
    rows = stored(rows.drop("_text").withColumn("_row", F.monotonically_increasing_id()), "secret-candidates")
    flat = rows.select("_row", F.col("_owner").alias("owner"), F.col("_repo").alias("repo"), F.explode("_found").alias("f"))
    flat = flat.select("_row", "owner", "repo", F.col("f.secret").alias("secret"), "f")
    counts = stored(ownership(flat.select("secret", "owner", "repo")), "secret-owners")
    base = F.col("f.kind").isin(*BASE_KINDS)
    verdict = (F.when(F.col("f.placeholder") | (F.col("owners") >= example_owners) | (F.col("repos") >= example_repos), "example")
               .when((F.col("owners") == 1) & (F.col("f.strength") >= min_entropy), "live").otherwise("unclear"))
    span = F.struct(F.col("f.start"), F.col("f.rank"), F.col("f.kind"), F.col("f.end"), base.alias("base"), "owners",
                    "repos", verdict.alias("verdict"))
    judged = (flat.join(counts, "secret").select("_row", span.alias("s"))
              .filter(F.col("s.base") | (F.col("s.verdict") != "example"))
              .groupBy("_row").agg(F.array_sort(F.collect_list("s")).alias("spans")))
    out = rows.select("_row", "_id").join(judged, "_row", "left")
    listed = F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"),
                                                     s["base"].alias("base"), s["owners"].alias("owners"),
                                                     s["repos"].alias("repos"), s["verdict"].alias("verdict")))
    return out.select(F.col("_id").alias(id_col), F.coalesce(listed, F.array()).alias("secret_spans"))
