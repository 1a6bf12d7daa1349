"""Secret scan over an incremental blob ledger.

Every version of every path is named by the SHA-256 of its content. A ledger table remembers which
(blob, rule version) pairs were scanned and what they gave; a run scans only the pairs that it lacks,
and joins the findings of all blobs back to all paths that ever held them.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dizin.llm.common import hinted, path_exists, scratch_path, text_key, written


@dataclass(frozen=True)
class Rule:
    """One kind of secret. ``group`` is the part whose length must reach ``least``; ``inner``: it ends the match and is the span by itself."""

    kind: str
    pattern: str
    group: int
    least: int
    any_case: bool = False
    version: int = 1
    inner: bool = False


#: Kinds, in the order in which ties are listed. The first three are the base kinds.
RULES = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, True),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]+", 0, 24),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 27),
    Rule("jwt", r"(?:^|[^A-Za-z0-9_-])(eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+)", 1, 30, inner=True),
    Rule("github", r"gh[opsu]_[A-Za-z0-9]+", 0, 40),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]+", 0, 20),
)
BASE = ("assign", "access", "hex")
FINDINGS = "array<struct<kind:string,start:int,end:int>>"


def compiled(rule: Rule) -> re.Pattern:
    return re.compile(rule.pattern, re.ASCII | (re.IGNORECASE if rule.any_case else 0))


def find(text: str, rules: list[tuple[Rule, re.Pattern]]) -> list[tuple[str, int, int]]:
    """Leftmost, non-overlapping matches of each kind that are long enough, by start, then kind as listed.

    No pattern tries a place of a run of letters anew for each place before it, so long texts take time in proportion.
    """
    found = []
    for order, (rule, pattern) in enumerate(rules):
        for m in pattern.finditer(text):
            if m.end(rule.group) - m.start(rule.group) >= rule.least:
                found.append((m.start(rule.group if rule.inner else 0), order, rule.kind, m.end()))
    return [(kind, start, end) for start, _, kind, end in sorted(found)]


def scan(versions: DataFrame, ledger: DataFrame | None = None, rules=RULES, text: str = "text") -> DataFrame:
    """New ledger entries: ``(blob_id, kind, rule_version, findings)`` for pairs that ``ledger`` lacks.

    ``versions`` has one row per version of a path; only its ``text`` column is used. A null text is the empty blob. Equal
    texts, at any number of paths, are scanned once. Without a ledger all are unseen; with one, the ids of blobs are held
    against it first, and only unseen blobs' texts go on. Spans count code points, end exclusive. Pairs without findings are
    entries too, so a later run knows them.
    """
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    named = versions.select(body.alias("blob_text"), text_key(body).alias("blob_id"))
    wanted = F.array(*[F.struct(F.lit(r.kind).alias("kind"), F.lit(r.version).alias("rule_version")) for r in rules])
    if ledger is not None:
        seen = ledger.groupBy("blob_id").agg(F.collect_set(F.struct("kind", "rule_version")).alias("seen"))
        known = F.coalesce("seen", F.array().cast("array<struct<kind:string,rule_version:int>>"))
        ids = named.select("blob_id").distinct().hint("merge").join(seen, "blob_id", "left").select("blob_id", F.array_except(wanted, known)["kind"].alias("kinds"))
        named = named.join(hinted(written(ids.filter(F.size("kinds") > 0), "unseen")), "blob_id")
    else:
        named = named.withColumn("kinds", wanted["kind"])
    todo = named.groupBy("blob_id").agg(F.first("blob_text").alias("blob_text"), F.first("kinds").alias("kinds"))
    listed = list(rules)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ready = {r.kind: (r, compiled(r)) for r in listed}
        for batch in batches:
            rows = []
            for blob_id, body, kinds in zip(batch["blob_id"], batch["blob_text"], batch["kinds"], strict=True):
                for kind in kinds:
                    got = [{"kind": k, "start": a, "end": b} for k, a, b in find(body, [ready[kind]])]
                    rows.append((blob_id, kind, ready[kind][0].version, got))
            yield pd.DataFrame(rows, columns=["blob_id", "kind", "rule_version", "findings"])

    return todo.mapInPandas(run, ENTRIES)


ENTRIES = f"blob_id string, kind string, rule_version int, findings {FINDINGS}"


def advance(versions: DataFrame, path: str, rules=RULES, text: str = "text") -> DataFrame:
    """The ledger at ``path`` (Parquet, in a shared store; made if it is not there) after this run, which appends what ``scan`` adds.

    A run that failed may be repeated: it scans what the ledger lacks.
    """
    spark = versions.sparkSession
    known = spark.read.schema(ENTRIES).parquet(path) if path_exists(spark, path) else None
    scan(versions, known, rules, text).write.mode("append").parquet(path)
    return spark.read.schema(ENTRIES).parquet(path)


def findings_by_path(versions: DataFrame, ledger: DataFrame, rules=RULES, text: str = "text") -> DataFrame:
    """Each row of ``versions`` with ``findings`` of its blob under the current rule versions, by start, then kind.

    Keeps every row and column (a column named ``findings`` or ``blob_id`` is replaced). Rows whose
    blob was never scanned have an empty list.
    """
    order = F.create_map(*[x for i, r in enumerate(rules) for x in (F.lit(r.kind), F.lit(i))])
    current = F.create_map(*[x for r in rules for x in (F.lit(r.kind), F.lit(r.version))])
    by_blob = (
        ledger.filter((F.col("rule_version") == current[F.col("kind")]) & (F.size("findings") > 0))
        .select("blob_id", F.explode("findings").alias("f"))
        .groupBy("blob_id")
        .agg(F.array_sort(F.collect_set(F.struct(F.col("f.start").alias("start"), order[F.col("f.kind")].alias("rank"), F.col("f.kind").alias("kind"), F.col("f.end").alias("end")))).alias("found"))
    )
    by_blob = written(by_blob, "found")
    kept = [F.col(f"`{c}`") for c in versions.columns if c not in ("findings", "blob_id")]
    out = versions.select(F.struct(*kept).alias("row"), text_key(F.col(f"`{text}`")).alias("blob_id"))
    empty = F.array().cast(FINDINGS)
    listed = F.transform("found", lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end")))
    return out.join(by_blob.hint("merge"), "blob_id", "left").select("row.*", "blob_id", F.coalesce(listed, empty).alias("findings"))


def spans_column(findings, kinds=None):
    """``kind:start:end`` of the findings, comma-joined."""
    kept = findings if kinds is None else F.filter(findings, lambda x: x["kind"].isin(*kinds))
    return F.array_join(F.transform(kept, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def digest(documents: DataFrame) -> DataFrame:
    """Per document: counts of the base kinds, the hash of their spans, and all spans.

    The ledger has two generations: half of the documents first, then all, of which the second run scans what the first did not
    see. Null texts are empty and have no secrets; repeated rows and null ids are returned as they are.
    """
    docs = documents.select("doc_id", "text")
    ledger = scratch_path(docs.sparkSession, "ledger")
    advance(docs.filter(F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0), ledger)
    found = findings_by_path(docs, advance(docs, ledger))
    count = lambda kind: F.size(F.filter("findings", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        "doc_id", *[count(k) for k in BASE],
        F.sha2(spans_column(F.col("findings"), BASE), 256).alias("base_sha256"),
        spans_column(F.col("findings")).alias("spans"),
    )


def brute(text: str | None) -> tuple[int, int, int, str, str]:
    """What ``digest`` gives for one text, the plain way."""
    found = find(text or "", [(r, compiled(r)) for r in RULES])
    joined = lambda kinds: ",".join(f"{k}:{a}:{b}" for k, a, b in found if k in kinds)
    n = [sum(k == b for k, _, _ in found) for b in BASE]
    return *n, hashlib.sha256(joined(BASE).encode()).hexdigest(), joined([r.kind for r in RULES])
