"""Look-ups of molecules in a terminology service, behind a provider.

A provider answers three calls with the service's JSON, or None for "not
found", and raises LookupFailed when the service didn't answer. The HTTP
provider needs the `requests` package and a network; tests use a table.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from brandloom.functions.text import ordered_unique
from brandloom.operators.coverage import not_yet_looked_up
from brandloom.session import ship
from brandloom.sources.tables import LOOKUP

NAMES = [f.split()[0] for f in LOOKUP.split(", ")]
ANSWERS = f"{LOOKUP}, attempt long"

EXACT = "struct<idGroup:struct<rxnormId:array<string>>>"
APPROXIMATE = "struct<approximateGroup:struct<candidate:array<struct<rxcui:string,score:string>>>>"
CLASSES = "struct<rxclassDrugInfoList:struct<rxclassDrugInfo:array<struct<rxclassMinConceptItem:struct<classId:string,className:string>>>>>"
RESPONSES = "molecule string, exact string, approximate string, classes string, status string"


class LookupFailed(Exception):
    """The service gave no answer after all tries."""


class Provider(Protocol):
    def exact(self, name: str) -> str | None: ...

    def approximate(self, name: str) -> str | None: ...

    def classes(self, rxcui: str) -> str | None: ...


class HttpProvider:
    """Three tries of 20 s, with a pause that grows by 1.5 s; 404 is "not found"."""

    def __init__(self, base: str, pause: float = 0.06, tries: int = 3, timeout: float = 20, wait: float = 1.5, agent: str = "brandloom/1.0", session=None):
        self.base, self.pause, self.tries, self.timeout, self.wait, self.agent, self.session = base.rstrip("/"), pause, tries, timeout, wait, agent, session

    def _get(self, path: str, **params: str | int) -> str | None:
        if self.session is None:
            import requests

            self.session = requests.Session()
        for k in range(self.tries):
            try:
                r = self.session.get(f"{self.base}/{path}", params=params, headers={"User-Agent": self.agent}, timeout=self.timeout)
                if r.status_code in (200, 404):
                    time.sleep(self.pause)
                    return r.text if r.status_code == 200 else None
            except OSError:  # the base of the package's own errors
                pass
            time.sleep(self.wait * (k + 1))
        raise LookupFailed(path)

    def exact(self, name: str) -> str | None:
        return self._get("rxcui.json", name=name, search=1)

    def approximate(self, name: str) -> str | None:
        return self._get("approximateTerm.json", term=name, maxEntries=1)

    def classes(self, rxcui: str) -> str | None:
        return self._get("rxclass/class/byRxcui.json", rxcui=rxcui, relaSource="ATC")


def exact_id(j: Column) -> Column:
    return F.get(F.from_json(j, EXACT)["idGroup"]["rxnormId"], F.lit(0))


def approximate_id(j: Column) -> tuple[Column, Column]:
    """The first candidate's id, and "approx:" with its score (0.0 if it is none)."""
    best = F.get(F.from_json(j, APPROXIMATE)["approximateGroup"]["candidate"], F.lit(0))
    score = F.coalesce(best["score"].try_cast("double"), F.lit(0.0))
    return F.nullif(best["rxcui"], F.lit("")), F.concat(F.lit("approx:"), F.format_string("%.1f", score))


def class_pairs(j: Column) -> Column:
    """array<struct<code,label>>: codes that aren't empty, each once, in order."""
    items = F.coalesce(F.from_json(j, CLASSES)["rxclassDrugInfoList"]["rxclassDrugInfo"], F.array())
    pairs = F.transform(items, lambda x: F.struct(x["rxclassMinConceptItem"]["classId"].alias("code"), F.coalesce(x["rxclassMinConceptItem"]["className"], F.lit("")).alias("label")))
    return ordered_unique(F.filter(pairs, lambda p: F.coalesce(p["code"], F.lit("")) != ""), "code")


def lookup_of(responses: DataFrame) -> DataFrame:
    """Lookup rows from raw responses: an exact id first, else the best approximate one."""
    exact = exact_id(F.col("exact"))
    near, how = approximate_id(F.col("approximate"))
    rows = responses.select("molecule", "status", F.coalesce(exact, near).alias("rxcui"), F.when(exact.isNotNull(), "exact").when(near.isNotNull(), how).otherwise("none").alias("match_method"), class_pairs(F.col("classes")).alias("p"))
    return rows.select("molecule", "rxcui", "match_method", F.transform("p", lambda x: x["code"]).alias("atc_codes"), F.transform("p", lambda x: x["label"]).alias("atc_names"), "status")


def fetch(molecules: DataFrame, provider: Callable[[], Provider], tasks: int = 1) -> DataFrame:
    """Raw responses of distinct molecules.

    `tasks` at once share the service's rate. By default it is one task that
    asks for one molecule after another: the service's limit on requests, not
    the number of executors, sets the pace.
    """
    import json

    def first(text: str | None, *path: str) -> str | None:
        value = json.loads(text) if text else None
        for key in path:
            value = (value or {}).get(key)
        return value

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        service = provider()
        for batch in batches:
            rows = []
            for name in batch["molecule"]:
                exact = near = classes = None
                try:
                    exact = service.exact(name)
                    ids = first(exact, "idGroup", "rxnormId") or []
                    rxcui = ids[0] if ids else None
                    if rxcui is None:
                        near = service.approximate(name)
                        found = first(near, "approximateGroup", "candidate") or []
                        rxcui = found[0].get("rxcui") if found else None
                    classes = service.classes(rxcui) if rxcui else None
                    rows.append((name, exact, near, classes, "found" if rxcui else "none"))
                except LookupFailed:
                    rows.append((name, exact, near, classes, "failed"))
            yield pd.DataFrame(rows, columns=["molecule", "exact", "approximate", "classes", "status"])

    ship(molecules.sparkSession)
    return molecules.select("molecule").where("molecule IS NOT NULL").distinct().repartition(tasks).mapInPandas(run, RESPONSES)


def refresh_lookup(inventory: DataFrame, lookup: DataFrame, provider: Callable[[], Provider], limit: int = 0, tasks: int = 1) -> DataFrame:
    """lookup plus rows for molecules that it hasn't got or that failed before.

    With `limit`, only the molecules with most products are looked up. Misses
    are kept and not asked again; failures are asked again next time. Every new
    molecule is asked for once each time the result is computed, so write it
    before using it twice; `refresh_store` does that, a batch at a time.
    """
    wanted = inventory.orderBy(F.desc("product_count"), "molecule").limit(limit) if limit else inventory
    missing = not_yet_looked_up(wanted, lookup).select("molecule")
    new = lookup_of(fetch(missing, provider, tasks))
    held = lookup if "status" in lookup.columns else lookup.withColumn("status", F.lit("found"))
    return held.select(*NAMES).join(missing, "molecule", "left_anti").select(*NAMES).unionByName(new.select(*NAMES))


def read_store(spark: SparkSession, store: str) -> DataFrame:
    """The latest answer for each molecule in a store; none where there is no store yet."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{store}/answers")
    if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], ANSWERS)
    latest = spark.read.schema(ANSWERS).json(str(path)).groupBy("molecule").agg(F.max_by(F.struct(*NAMES[1:], "attempt"), "attempt").alias("r"))
    return latest.select("molecule", "r.*")


def refresh_store(inventory: DataFrame, store: str, provider: Callable[[], Provider], limit: int = 0, tasks: int = 1, batch: int = 25, lookup: DataFrame | None = None, progress: Callable[[dict], None] | None = None) -> DataFrame:
    """Look up what a store hasn't got, about `batch` molecules at a time; the lookup with all answers.

    Each batch is saved under `store` before the next is asked for, so a run
    that ends early, for whatever reason, goes on where it stopped and asks for
    nothing again that was answered. Answers of `lookup` count as known.
    Misses are answers; failures are asked again by the next run. `progress`
    gets the counts of each batch as it is written.
    """
    spark = inventory.sparkSession
    known = read_store(spark, store)
    attempt = 1 + (known.agg(F.max("attempt").alias("n")).first()["n"] or 0)
    held = known.select(*NAMES)
    if lookup is not None:
        given = lookup if "status" in lookup.columns else lookup.withColumn("status", F.lit("found"))
        held = held.unionByName(given.select(*NAMES).join(held.select("molecule"), "molecule", "left_anti").select(*NAMES))
    wanted = inventory.orderBy(F.desc("product_count"), "molecule").limit(limit) if limit else inventory
    pending = f"{store}/pending-{attempt}"
    not_yet_looked_up(wanted, held).where("molecule IS NOT NULL").select("molecule").distinct().write.mode("overwrite").parquet(pending)
    new = spark.read.schema("molecule string").parquet(pending)
    total = new.count()
    batches = -(-total // batch)
    done = 0
    for k in range(batches):  # one after another, as the service's rate wants it
        part = new.where(F.pmod(F.xxhash64("molecule"), F.lit(batches)) == k)
        seen = Observation(f"lookup-{attempt}-{k}")
        rows = lookup_of(fetch(part, provider, tasks)).select(*NAMES, F.lit(attempt).cast("long").alias("attempt"))
        counts = (F.count(F.lit(1)).alias("asked"), F.count_if(F.size("atc_codes") > 0).alias("with_atc"), F.count_if(F.col("status") == "failed").alias("failed"))
        rows.observe(seen, *counts).write.mode("append").json(f"{store}/answers")
        done += seen.get["asked"]
        if progress:
            progress({"done": done, "of": total, **seen.get})
    latest = read_store(spark, store).select(*NAMES)
    return latest if lookup is None else latest.unionByName(held.join(latest.select("molecule"), "molecule", "left_anti").select(*NAMES))
