"""Secret scan with an incremental ledger of content-addressed blobs.

Every historical version of a file is a row (path, text). A version's blob is the SHA-256 of its text. The ledger
remembers which (blob, rule version) pairs were scanned and what they held; a run scans the missing pairs only, each
distinct blob once, and joins the findings back to every path that ever held the blob. A rule whose pattern changes gets
a new version, so only that rule is run again over old blobs.

Defined cases: a NULL text is the empty blob; a NULL path is kept; repeated rows give repeated results; an empty table
gives an empty result; columns beyond the two named ones are ignored. A text is scanned whole whatever its length.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortspark.llm.common import stage

LEDGER = T.StructType([
    T.StructField("blob", T.StringType()),
    T.StructField("rules", T.ArrayType(T.StringType())),
    T.StructField("spans", T.ArrayType(T.StructType([
        T.StructField("start", T.IntegerType()), T.StructField("rank", T.IntegerType()),
        T.StructField("end", T.IntegerType()), T.StructField("rule", T.StringType())]))),
])


@dataclass(frozen=True)
class Rule:
    """``pattern`` finds leftmost non-overlapping matches, of which the group ``span`` is the finding; those whose ``group`` is
    shorter than ``least`` are dropped. Every match holds the text ``needs``, so texts without it are not searched."""

    kind: str
    version: int
    pattern: str
    group: int = 0
    least: int = 0
    span: int = 0
    needs: str = ""

    @property
    def key(self) -> str:
        return f"{self.kind}@{self.version}"


#: A token starts at the first "eyJ" of a run. Runs are entered at their start only and nothing is given back, so the time
#: is linear in the text however often "eyJ" repeats.
RUN = "[A-Za-z0-9_-]"
TOKEN = rf"(?<!{RUN})(?:(?!eyJ){RUN})*+(eyJ{RUN}++\.eyJ{RUN}++\.{RUN}++)"

# What counts as a secret.
RULES = (
    Rule("assign", 1, r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", 1, r"AKIA[A-Z0-9]+", 0, 20, needs="AKIA"),
    Rule("hex", 1, r"[0-9a-f]{24,}", 0, 24),
    Rule("pem", 1, r"-----BEGIN [A-Z ]*PRIVATE KEY-----", needs="-----BEGIN "),
    Rule("jwt", 2, TOKEN, span=1, needs="eyJ"),
)
BASE_KINDS = ("assign", "access", "hex")


def find(text: str, rules: tuple[Rule, ...], wanted: set[str]) -> list[tuple[int, int, int, str]]:
    """Spans (start, rank of the rule, end, rule) in code points, by start and rule order."""
    spans = [
        (m.start(rule.span), rank, m.end(rule.span), rule.key)
        for rank, rule in enumerate(rules) if rule.key in wanted and rule.needs in text
        for m in re.finditer(rule.pattern, text) if m.end(rule.group) - m.start(rule.group) >= rule.least]
    spans.sort()
    return spans


def _scanner(rules: tuple[Rule, ...]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    span = pa.struct([("start", pa.int32()), ("rank", pa.int32()), ("end", pa.int32()), ("rule", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            blobs, texts, missing = (batch.column(c) for c in ("blob", "text", "rules"))
            found = [[dict(zip(("start", "rank", "end", "rule"), s)) for s in find(t.as_py(), rules, set(m.as_py()))]
                     for t, m in zip(texts, missing)]
            yield pa.RecordBatch.from_arrays([blobs, missing, pa.array(found, pa.list_(span))], names=["blob", "rules", "spans"])

    return run


def scan(
    versions: DataFrame, path: str, text: str, rules: tuple[Rule, ...] = RULES, ledger: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(findings per version, ledger entries of this run).

    Findings: ``path``, blob, spans ordered by start. The entries are already written to the shared folder; append them
    to the ledger to make the next run incremental. Texts move once, after each map task has reduced its copies of a
    blob to one; paths move without their texts."""
    keys = [r.key for r in rules]
    seen = versions.select(F.col(path).alias("path"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    seen = seen.withColumn("blob", F.sha2("text", 256))
    blobs = seen.groupBy("blob").agg(F.any_value("text").alias("text"))
    every = F.array(*[F.lit(k) for k in keys])
    if ledger is None:
        todo = blobs.withColumn("rules", every)
    else:
        done = ledger.groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_list("rules"))).alias("done"))
        todo = blobs.join(done, "blob", "left").withColumn("rules", F.array_except(every, F.coalesce("done", F.array().cast("array<string>"))))
        todo = todo.where(F.size("rules") > 0)
    entries = stage(todo.select("blob", "text", "rules").mapInArrow(_scanner(rules), LEDGER))
    known = entries if ledger is None else ledger.select("blob", "rules", "spans").unionByName(entries)
    current = F.filter(F.flatten(F.collect_list("spans")), lambda s: s["rule"].isin(keys))
    spans = known.where(F.size("spans") > 0).groupBy("blob").agg(F.array_sort(F.array_distinct(current)).alias("spans"))
    findings = seen.select("path", "blob").join(spans, "blob", "left")
    return findings.select(F.col("path").alias(path), "blob", F.coalesce("spans", F.array().cast(LEDGER["spans"].dataType)).alias("spans")), entries


def digest(findings: DataFrame, path: str, base: tuple[str, ...] = BASE_KINDS) -> DataFrame:
    """Counts per base kind, the digest of the base spans and all spans as text."""
    kind = lambda s: F.split_part(s["rule"], F.lit("@"), F.lit(1))
    printed = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat(kind(s), F.lit(":"), s["start"], F.lit(":"), s["end"])), ",")
    of_kinds = lambda *kinds: F.filter("spans", lambda s: kind(s).isin(*kinds))
    of_base = of_kinds(*base)
    return findings.select(
        path, *[F.size(of_kinds(k)).cast("long").alias(f"n_{k}") for k in base],
        F.sha2(printed(of_base), 256).alias("base_sha256"), printed(F.col("spans")).alias("spans"))
