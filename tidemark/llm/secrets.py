"""Secret scans with multipart credential linking.

Strong patterns stand alone. Weak parts (client identifiers, bare key material, endpoints) are candidates only: an
interval join on (document, stretch of text) pairs them with the parts within a scope of code points around them, and
a candidate is reported if its complements are among these.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_or_empty, write_shared

# The base patterns, in the order in which ties of the start are listed. ASCII: no other letter is a case of k or s.
ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")  # a maximal run, as [0-9a-f]+ is
# Weak parts.
CLIENT = re.compile(r"""(?i:client_?id|access_?key_?id|account|user(?:name)?)["']?\x20*[:=]\x20*["']?[A-Za-z0-9@._-]{4,}""", re.ASCII)
MATERIAL = re.compile(r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z0-9+/]*[0-9])(?=[A-Za-z0-9+/]*[A-Z])(?=[A-Za-z0-9+/]*[a-z])[A-Za-z0-9+/]{20,}={0,2}(?![A-Za-z0-9+/_=-])")
ENDPOINT = re.compile(r"""[a-z][a-z0-9+]{1,15}://[^\s"'<>|]{3,}""")

KINDS = ("assign", "access", "hex", "client", "material", "endpoint")
#: The part that each kind is, and the parts that must be near for a weak one to count.
ROLES = {"assign": "secret", "access": "identifier", "hex": "secret", "client": "identifier", "material": "secret", "endpoint": "endpoint"}
NEEDS = {"client": ("secret",), "material": ("identifier",), "endpoint": ("secret", "identifier")}

_SPANS = "doc_id long, text_hash long, n_assign long, n_access long, n_hex long, base_sha256 string, base array<struct<start:int,kind:int,end:int>>, parts array<struct<start:int,kind:int,end:int>>"


def base_spans(text: str, low: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the strong patterns: leftmost, not overlapping within a kind, sorted."""
    found = []
    if any(k in low for k in ("passw", "secret", "token", "api")):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def weak_parts(text: str, low: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Weak candidates that don't overlap a base span; none where the text cannot hold their complements."""
    client = [(m.start(), 3, m.end()) for m in CLIENT.finditer(text)] if any(k in low for k in ("client", "access", "account", "user")) else []
    if not client and not any(kind == 1 for _, kind, _ in base) and not base:
        return []
    found = client + [(m.start(), 4, m.end()) for m in MATERIAL.finditer(text)]
    if "://" in text:
        found += [(m.start(), 5, m.end()) for m in ENDPOINT.finditer(text)]
    taken, out, k = base, [], 0
    for s, kind, e in sorted(found):
        while k < len(taken) and taken[k][2] <= s:
            k += 1
        if not any(b[0] < e and s < b[2] for b in taken[max(0, k - 2) : k + 3]):
            out.append((s, kind, e))
    return out


def _text(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{s}:{e}" for s, kind, e in spans)


def find_spans(docs: DataFrame) -> DataFrame:
    """Base spans of each document, and the parts that linking looks at; whole texts, a row per row."""

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cols = [c.split()[0] for c in _SPANS.split(", ")]
        empty = hashlib.sha256(b"").hexdigest()
        for batch in batches:
            rows = []
            for doc_id, text_hash, text in zip(batch["doc_id"].astype(object).where(batch["doc_id"].notna(), None), batch["text_hash"], batch["text"]):
                low = text.lower()  # for quick tests only: it may be longer than the text
                base = base_spans(text, low)
                weak = weak_parts(text, low, base)
                n = [0, 0, 0]
                for _, kind, _ in base:
                    n[kind] += 1
                digest = hashlib.sha256(_text(base).encode()).hexdigest() if base else empty
                rows.append((doc_id, text_hash, *n, digest, base, base + weak if weak else []))
            out = pd.DataFrame(rows, columns=cols)
            out["doc_id"] = out["doc_id"].astype("Int64")
            yield out

    text = text_or_empty()
    return docs.select(F.col("doc_id").cast("long"), F.xxhash64(text).alias("text_hash"), text.alias("text")).mapInPandas(scan, _SPANS)


def link_parts(spans: DataFrame, scope: int = 256) -> DataFrame:
    """doc_id, text_hash, start, kind, end of the weak parts whose complements lie within scope code points.

    The join is on document and stretch of scope code points; a part stands in its own stretches and those next to
    them, so a document of any length with any number of parts is spread by its stretches.
    """
    kind = lambda of: F.element_at(F.array(*[F.lit(of(k)) for k in KINDS]), F.col("part.kind") + 1)
    parts = spans.where(F.size("parts") > 0).select("doc_id", "text_hash", F.explode("parts").alias("part"))
    parts = parts.select("doc_id", "text_hash", "part.*", kind(lambda k: ROLES[k]).alias("role")).distinct()  # repeated rows count once
    near = parts.select(
        F.col("doc_id").alias("d"), F.col("text_hash").alias("h"), F.col("start").alias("s"), F.col("end").alias("e"), F.col("role").alias("r"),
        F.explode(F.sequence(F.floor(F.col("start") / scope) - 1, F.floor(F.col("end") / scope) + 1)).alias("near"),
    )
    weak = parts.where(F.col("kind") >= 3).withColumn("stretch", F.explode(F.sequence(F.floor(F.col("start") / scope), F.floor(F.col("end") / scope))))
    gap = F.greatest(F.col("s") - F.col("end"), F.col("start") - F.col("e"))
    pairs = weak.join(near, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_hash") == F.col("h")) & (F.col("stretch") == F.col("near")) & (gap <= scope))
    has = lambda role: F.max(F.when(F.col("r") == role, 1).otherwise(0)) == 1
    seen = pairs.groupBy("doc_id", "text_hash", "start", "kind", "end").agg(has("secret").alias("secret"), has("identifier").alias("identifier"))
    met = F.lit(False)
    for name, needs in NEEDS.items():
        held = F.col("kind") == KINDS.index(name)
        for n in needs:
            held = held & F.col(n)
        met = met | held
    return seen.where(met).select("doc_id", "text_hash", "start", "kind", "end")


def scan_secrets(docs: DataFrame, scope: int = 256) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans (all, as kind:start:end), and both span lists.

    A row per row of docs. Null or empty text: no spans. Repeated rows: the same result each. Very long texts are
    scanned whole. Rows with one doc_id and different texts are kept apart by the hash of the text. Extra columns
    do not matter.
    """
    found = write_shared(find_spans(docs), "secrets")
    linked = link_parts(found, scope).groupBy("doc_id", "text_hash").agg(F.collect_set(F.struct("start", "kind", "end")).alias("linked"))
    f, k = found.alias("f"), linked.alias("k")
    joined = f.join(k, F.col("f.doc_id").eqNullSafe(F.col("k.doc_id")) & (F.col("f.text_hash") == F.col("k.text_hash")), "left")
    linked_spans = F.coalesce(F.col("linked"), F.array().cast("array<struct<start:int,kind:int,end:int>>"))
    spans = F.array_sort(F.concat("base", linked_spans))
    names = F.array(*[F.lit(k) for k in KINDS])
    shown = lambda x: F.concat_ws(":", F.element_at(names, x["kind"] + 1), x["start"].cast("string"), x["end"].cast("string"))
    return joined.select(
        F.col("f.doc_id").alias("doc_id"), "n_assign", "n_access", "n_hex", "base_sha256",
        F.concat_ws(",", F.transform(spans, shown)).alias("spans"), F.size(linked_spans).cast("long").alias("n_linked"), F.col("f.text_hash").alias("text_hash"), spans.alias("span_list"),
    )


def redact(docs: DataFrame, scope: int = 256, mark: str = "[SECRET]", broadcast_rows: int = 1_000_000) -> DataFrame:
    """docs with every span of scan_secrets() replaced by mark, overlapping ones by one; n_chars follows where it is a column.

    Documents without spans pass as they are. The spans go to the texts by broadcast only if the documents that have
    any are counted to be few; else the join shuffles.
    """
    found = scan_secrets(docs, scope).where(F.size("span_list") > 0).select(F.col("doc_id").alias("_tidemark_id"), F.col("text_hash").alias("_tidemark_hash"), F.col("span_list").alias("_tidemark_spans")).dropDuplicates(["_tidemark_id", "_tidemark_hash"])
    found = write_shared(found, "secrets-found")
    if found.count() <= broadcast_rows:
        found = F.broadcast(found)
    columns = docs.columns
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("_tidemark_id")) & (F.xxhash64(text_or_empty()) == F.col("_tidemark_hash"))

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = []
            for text, spans in zip(batch["text"], batch["_tidemark_spans"]):
                out, at = [], 0
                for s, e in sorted((x["start"], x["end"]) for x in spans):
                    if e > at:
                        out += [text[at:s], mark] if s >= at else []
                        at = e
                texts.append("".join([*out, text[at:]]))
            batch = batch.assign(text=texts)
            if "n_chars" in columns:
                batch = batch.assign(n_chars=[len(t) for t in texts])
            yield batch[columns]

    clean = docs.join(found, same, "left_anti")
    return clean.unionByName(docs.join(found, same).select(*columns, "_tidemark_spans").mapInPandas(cut, docs.schema))
