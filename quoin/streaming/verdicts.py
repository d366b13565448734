"""Findings that follow their documents and profiles: a keyed stream that re-evaluates what a change touches.

Two folders are read as streams: measures of documents (measures() of landed facts) and profiles. A
document's measures and its last version are state, so a new version of a profile needs
no file again; what comes late, an older version of either, is dropped. Out come changed findings alone.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from quoin.operators.aggregates import distinct_sorted
from quoin.plans.preflight import DEFAULTS, MM_PT, bleed_of, gradeable

BUCKETS = 200  #: keys that documents are dealt to; each profile goes to every one
MEASURES = "doc_id string, version long, measures string"
PROFILES = "profile_id string, version long, settings string"
CHANGES = "doc_id string, version long, profile_id string, profile_version long, id string, change string, level string, pages array<int>"
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

#: measure: (id of the rule, setting, which side of it is wrong, slack, factor of the setting, level)
RULES = {
    "bleed": ("bleed", "bleed_mm", "below", 0.05, MM_PT, "error"),
    "ppi": ("image-ppi", "min_ppi", "below", 0.5, 1.0, "warn"),
    "ink": ("total-ink", "max_ink", "above", 0.5, 1.0, "warn"),
    "rgb": ("rgb", "allow_rgb", "unless", 0.0, 1.0, "warn"),
    "spot": ("spot", "allow_spot", "unless", 0.0, 1.0, "warn"),
}


def measures(facts: dict[str, DataFrame], version: int | None = None) -> DataFrame:
    """(doc_id, version, measures) of each document: for every measure its distinct values
    and the pages that have them, as JSON. Any threshold can be tried on them later."""
    doc = facts["doc"].where("error is null").select("doc_id")
    painted = lambda kind: facts["paint"].where(F.col("kind") == kind)
    parts = {
        "bleed": bleed_of(facts["page"]).where("bleed_pt is not null").select("doc_id", "page", F.col("bleed_pt").alias("value")),
        "ppi": gradeable(facts["placement"]).select("doc_id", "page", F.col("ppi").alias("value")),
        "ink": painted("cmyk").where("tac is not null").select("doc_id", "page", F.col("tac").alias("value")),
        "rgb": painted("rgb").select("doc_id", "page", F.lit(1.0).alias("value")).unionByName(facts["placement"].where("family = 'RGB' and not mask and not soft_mask").select("doc_id", "page", F.lit(1.0).alias("value"))),
        "spot": painted("spot").select("doc_id", "page", F.lit(1.0).alias("value")),
    }
    rows = None
    for name, part in parts.items():
        one = part.groupBy("doc_id", "value").agg(distinct_sorted("page").alias("pages")).select("doc_id", F.lit(name).alias("name"), "value", "pages")
        rows = one if rows is None else rows.unionByName(one)
    by_name = rows.groupBy("doc_id", "name").agg(F.sort_array(F.collect_list(F.struct("value", "pages"))).alias("values"))
    all_ = by_name.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("name", "values"))).alias("m"))
    at = F.lit(version).cast("long") if version is not None else F.unix_micros(F.current_timestamp())
    return doc.join(all_, "doc_id", "left").select("doc_id", at.alias("version"), F.coalesce(F.to_json("m"), F.lit("{}")).alias("measures"))


def findings_of(measured: dict[str, list[dict]], settings: dict) -> dict[str, tuple[str, list[int]]]:
    """{id: (level, pages)} of one document under one profile; without a fault there is no entry."""
    out = {}
    for name, (id, setting, side, slack, factor, level) in RULES.items():
        limit = settings.get(setting, DEFAULTS[setting])
        if side == "unless":
            wrong = (lambda v: not limit) if not limit else (lambda v: False)  # noqa: B023
        elif side == "below":
            wrong = lambda v: v + slack < limit * factor  # noqa: E731, B023
        else:
            wrong = lambda v: 0 < limit * factor < v - slack  # noqa: E731, B023
        pages = sorted({p for x in measured.get(name, []) if wrong(x["value"]) for p in x["pages"]})
        if pages:
            out[id] = (level, pages)
    return out


class Evaluator(StatefulProcessor):
    """State of one bucket: measures by document, settings by profile, findings by both."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        one = lambda *names: T.StructType([T.StructField(n, T.StringType()) for n in names])
        held = T.StructType([T.StructField("version", T.LongType()), T.StructField("json", T.StringType())])
        self.docs = handle.getMapState("docs", one("doc_id"), held)
        self.profiles = handle.getMapState("profiles", one("profile_id"), held)
        self.found = handle.getMapState("found", one("doc_id", "profile_id"), one("json"))

    def changes(self, doc: str, doc_at: tuple, profile: str, profile_at: tuple) -> Iterator[tuple]:
        """What is new, changed or gone for one document under one profile."""
        now = findings_of(json.loads(doc_at[1]), json.loads(profile_at[1]))
        key = (doc, profile)
        before = json.loads(self.found.getValue(key)[0]) if self.found.containsKey(key) else {}
        before = {id: (level, pages) for id, (level, pages) in before.items()}
        if now != before:
            self.found.updateValue(key, (json.dumps(now),))
        for id in sorted(now.keys() | before.keys()):
            if now.get(id) != before.get(id):
                change = "new" if id not in before else "gone" if id not in now else "changed"
                level, pages = now.get(id) or before[id]
                yield doc, doc_at[0], profile, profile_at[0], id, change, level, pages if id in now else []

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        """Latest versions first replace what is held; then each pair of which a side is new is evaluated once."""
        fresh: dict[str, dict[str, tuple]] = {"doc": {}, "profile": {}}
        for batch in rows:
            for kind, id, version, text in zip(batch["kind"], batch["id"], batch["version"], batch["json"]):
                store = self.docs if kind == "doc" else self.profiles
                held = fresh[kind].get(id) or (tuple(store.getValue((id,))) if store.containsKey((id,)) else None)
                if held is None or version > held[0]:
                    fresh[kind][id] = (int(version), text)
        for kind, store in (("doc", self.docs), ("profile", self.profiles)):
            for id, value in fresh[kind].items():
                store.updateValue((id,), value)
        out = []
        known = {k[0]: tuple(v) for k, v in self.profiles.iterator()}  # the users' few rows
        for doc, at in fresh["doc"].items():
            for profile, settings in known.items():
                out += self.changes(doc, at, profile, settings)
        if fresh["profile"]:
            for k, at in list(self.docs.iterator()):
                if k[0] not in fresh["doc"]:
                    for profile, settings in fresh["profile"].items():
                        out += self.changes(k[0], tuple(at), profile, settings)
        if out:
            yield pd.DataFrame(out, columns=[c.split()[0] for c in CHANGES.split(", ")])

    def close(self) -> None:
        pass


def changed_findings(documents: DataFrame, profiles: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """CHANGES from two streams, MEASURES and PROFILES. Documents are dealt to buckets by their ids; a
    profile is sent to all buckets, so that each re-evaluates the documents that it holds.

    Of several versions of one id the highest counts, whatever order they come in; one that is not higher
    than what is held changes nothing. Unknown settings are not used, missing ones take their defaults."""
    docs = documents.select(F.pmod(F.xxhash64("doc_id"), F.lit(buckets)).cast("int").alias("bucket"), F.lit("doc").alias("kind"), F.col("doc_id").alias("id"), "version", F.col("measures").alias("json"))
    every = profiles.select(F.explode(F.sequence(F.lit(0), F.lit(buckets - 1))).alias("bucket"), F.lit("profile").alias("kind"), F.col("profile_id").alias("id"), "version", F.col("settings").alias("json"))
    events = docs.unionByName(every).where("id is not null and version is not null and json is not null")
    return events.groupBy("bucket").transformWithStateInPandas(statefulProcessor=Evaluator(), outputStructType=CHANGES, outputMode="Append", timeMode="None")


def follow(spark: SparkSession, documents: str, profiles: str, store: str, checkpoint: str, buckets: int = BUCKETS, **trigger):
    """Append changed findings to Parquet at store, as measures and profiles arrive in two
    folders (Parquet of measures(), JSON lines of PROFILES). The state lies in RocksDB, so a bucket may hold more than memory."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    docs = spark.readStream.schema(MEASURES).parquet(documents)
    found = changed_findings(docs, spark.readStream.schema(PROFILES).json(profiles), buckets)
    return found.writeStream.format("parquet").option("path", store).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
