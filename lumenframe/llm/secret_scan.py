"""Secret scan with corpus-wide ownership frequency.

One pass finds candidates in every text: the base patterns, and wider ones for strings that may be credentials.
Spark counts for each candidate's digest in how many documents and under how many owners it occurs. A wide candidate
that many owners share is an example from a manual; one that stays with one owner, or few, looks live and its spans
are reported beside the base spans.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate, groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .shared import HashSet, hash_set, keep

KINDS = ("assign", "access", "hex")  # base kinds, in order
WIDE = ("key", "token", "random")  # the method's kinds
MAX_OWNERS = 2  # owners up to which a wide candidate looks live
_KEYWORDS = ("password", "passwd", "secret", "token", "api")
ASSIGN = re.compile(
    r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")  # the runs of 16 or more among all runs
KEY = re.compile(r"-----BEGIN [A-Z ]*PRIVATE KEY-----.*?(?:-----END [A-Z ]*PRIVATE KEY-----|\Z)", re.S)
#: Fixed prefixes of tokens that services issue.
TOKEN = re.compile(
    r"(?:gh[pousr]_[A-Za-z0-9]{20,}|xox[abprs]-[A-Za-z0-9-]{10,}|sk_(?:live|test)_[A-Za-z0-9]{10,}|AIza[A-Za-z0-9_-]{30,}|"
    r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+|glpat-[A-Za-z0-9_-]{16,})")
RANDOM = re.compile(r"[A-Za-z0-9+/_-]{24,}={0,2}")
_TOKEN_STARTS = ("gh", "xox", "sk_", "AIza", "eyJ", "glpat-")


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the base patterns, by start and then kind."""
    found = []
    low = text.lower() if text.isascii() else text.translate(_ASCII_LOWER)
    if any(k in low for k in _KEYWORDS):
        found += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        found += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= 18]
    found += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


_ASCII_LOWER = {i: i + 32 for i in range(65, 91)}


def wide_spans(text: str) -> list[tuple[str, int, int]]:
    """Further strings that may be credentials: key blocks, service tokens, random-looking words."""
    found = []
    if "PRIVATE KEY-----" in text:
        found += [("key", m.start(), m.end()) for m in KEY.finditer(text)]
    if any(s in text for s in _TOKEN_STARTS):
        found += [("token", m.start(), m.end()) for m in TOKEN.finditer(text)]
    found += [("random", m.start(), m.end()) for m in RANDOM.finditer(text) if _random(m[0])]
    return found


def _random(word: str) -> bool:
    """Mixed classes of characters, spread as evenly as chance would."""
    if not (any(c.isdigit() for c in word) and any(c.isupper() for c in word) and any(c.islower() for c in word)):
        return False
    counts = Counter(word).values()
    return -sum(c / len(word) * math.log2(c / len(word)) for c in counts) >= 3.5


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


_SPAN = "array<struct<kind:string,s:bigint,e:bigint,digest:string>>"


def _found(text: str) -> list[tuple[str, int, int]]:
    """All candidates of a text; wide ones that touch a base span are that span's and left out."""
    found = base_spans(text)
    for _, own in groupby(wide_spans(text), key=lambda span: span[0]):  # spans of one kind never touch each other
        taken = sorted((s, e) for _, s, e in found)
        starts, reach = [s for s, _ in taken], list(accumulate((e for _, e in taken), max))
        for span in list(own):
            before = bisect_left(starts, span[2])
            if not before or reach[before - 1] <= span[1]:
                found.append(span)
    return found


def _scan_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per text: its candidates with their digests."""
    span = pa.struct([("kind", pa.string()), ("s", pa.int64()), ("e", pa.int64()), ("digest", pa.string())])
    for batch in batches:
        spans = [[{"kind": k, "s": s, "e": e, "digest": _digest(text[s:e])} for k, s, e in _found(text)]
                 for text in (t or "" for t in batch.column("text").to_pylist())]
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(c) for c in ("doc_id", "owner", "key")), pa.array(spans, pa.list_(span))],
            ["doc_id", "owner", "key", "found"])


def _digest(candidate: str) -> str:
    """Digest of the credential itself: of an assignment, what is assigned."""
    own = ASSIGN.fullmatch(candidate)
    return hashlib.sha256((own[2] if own else candidate).encode()).hexdigest()


def _scanned(docs: DataFrame, owner: Column | None) -> DataFrame:
    kind = docs.schema["doc_id"].dataType.simpleString()
    key = F.xxhash64("doc_id", "text")
    whose = owner if owner is not None else F.col("source")
    return docs.select("doc_id", "text", F.coalesce(whose.cast("string"), key.cast("string")).alias("owner"),
                       key.alias("key")).mapInArrow(
        _scan_rows, f"doc_id {kind}, owner string, key long, found {_SPAN}")


def _candidates(scanned: DataFrame) -> DataFrame:
    return scanned.where(F.size("found") > 0).select("owner", "key", F.explode("found").alias("span")).select(
        "owner", "key", "span", "span.digest")


def _owner_counts(candidates: DataFrame) -> DataFrame:
    """Owners of each candidate: distinct (digest, owner) pairs first, so that a copied one costs a row per task."""
    return candidates.select("digest", "owner").distinct().groupBy("digest").agg(F.count("*").alias("owners"))


def find_secrets(docs: DataFrame, owner: Column | None = None, max_owners: int = MAX_OWNERS) -> DataFrame:
    """(doc_id, key, base, live) per row: all base spans, and all spans, base or wide, that look live.

    ``owner`` says whose a document is (default: its source); without one, the document is its own. A candidate is
    live when at most ``max_owners`` owners hold it anywhere in the corpus. Null texts are empty. Rows repeated
    exactly are one document to the counts and each get their spans; rows without doc_id are told apart by their
    text. Offsets are code points. Other columns are ignored.
    """
    scanned = keep(_scanned(docs, owner), "candidates")
    candidates = _candidates(scanned)
    owners = _owner_counts(candidates).where(F.col("owners") <= max_owners)
    live = candidates.select("key", "span", "digest").distinct().join(owners, "digest").groupBy("key").agg(
        F.collect_list("span").alias("live"))
    base = F.filter("found", lambda x: x["kind"].isin(*KINDS)).alias("base")
    with_live = scanned.where(F.size("found") > 0).join(live, "key", "left").select(
        "doc_id", "key", base, F.coalesce("live", F.array().cast(_SPAN)).alias("live"))
    return with_live.unionByName(scanned.where(F.size("found") == 0).select(
        "doc_id", "key", base, F.array().cast(_SPAN).alias("live")))


def digests(found: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256 and spans of what ``find_secrets`` gives."""
    def text(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["s"], x["e"])), ",")

    def count(kind: str) -> Column:
        return F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    wide = F.filter("live", lambda x: x["kind"].isin(*WIDE))
    rank = F.create_map(*(F.lit(x) for i, k in enumerate((*KINDS, *WIDE)) for x in (k, i)))
    ordered = F.transform(F.array_sort(F.transform(F.concat("base", wide), lambda x: F.struct(
        x["s"].alias("s"), rank[x["kind"]].alias("rank"), x["kind"].alias("kind"), x["e"].alias("e")))),
        lambda x: F.struct(x["kind"].alias("kind"), x["s"].alias("s"), x["e"].alias("e")))
    return found.select("doc_id", *map(count, KINDS), F.sha2(text(F.col("base")), 256).alias("base_sha256"),
                        text(ordered).alias("spans"))


def copied_examples(docs: DataFrame, owner: Column | None = None, max_owners: int = MAX_OWNERS) -> HashSet:
    """Digests of the candidates that more than ``max_owners`` owners hold, as a set that tasks can map."""
    counts = _owner_counts(_candidates(_scanned(docs, owner)))
    return hash_set(counts.where(F.col("owners") > max_owners).select(
        F.conv(F.substring("digest", 1, 15), 16, 10).cast("long").alias("short")), "short", "copied-examples")


def redact(docs: DataFrame, copied: HashSet, mask: str = "[secret]") -> DataFrame:
    """``docs`` with every candidate that is not a copied example replaced by ``mask``; other texts stay as they are."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = copied.reader()
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for i, text in enumerate(texts):
                spans = _found(text or "")
                if spans:
                    short = np.array([int(_digest(text[s:e])[:15], 16) for _, s, e in spans], np.int64)
                    live = ~copied.contains(reader, short)
                    texts[i] = _masked(text, [(s, e) for (_, s, e), x in zip(spans, live, strict=True) if x], mask)
            yield batch.set_column(batch.schema.get_field_index("text"), "text", pa.array(texts, batch.column("text").type))

    return docs.mapInArrow(run, docs.schema)


def _masked(text: str, spans: list[tuple[int, int]], mask: str) -> str:
    """Replace spans, overlapping ones as one."""
    pieces, at = [], 0
    for s, e in sorted(spans):
        if s >= at:
            pieces += [text[at:s], mask]
        at = max(at, e)
    return "".join([*pieces, text[at:]])
