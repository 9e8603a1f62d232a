"""Results out: relations as Parquet or tab-separated files, counts, findings as SARIF, directives as JSON."""

from __future__ import annotations

import time
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def export(relations: dict[str, DataFrame], folder: str, format: str = "parquet") -> None:
    """Each relation under its name; "csv" writes tab-separated text without header."""
    for name, df in relations.items():
        if format == "csv":
            df.write.mode("overwrite").csv(f"{folder}/{name}.csv", sep="\t", quote="", header=False)
        else:
            df.write.mode("overwrite").format(format).save(f"{folder}/{name}")


def write_outputs(result, program, folder: str) -> None:
    """The relations that a program's ``.output`` directives name, as text. Options: filename (default: the relation's
    name and ``.csv``), delimiter (default: a tab), headers ("true": names in the first line of each part)."""
    for name, options in program.outputs.items():
        header = options.get("headers", "false") == "true"
        result[name].write.mode("overwrite").csv(f"{folder}/{options.get('filename', f'{name}.csv')}", sep=options.get("delimiter", "\t"), quote="", escape="", header=header, emptyValue="")


def sizes(spark: SparkSession, relations: dict[str, DataFrame]) -> DataFrame:
    """relation and its number of tuples, one aggregate for each."""
    out = None
    for name, df in sorted(relations.items()):
        one = df.agg(F.count("*").alias("tuples")).select(F.lit(name).alias("relation"), "tuples")
        out = one if out is None else out.unionByName(one)
    return out if out is not None else spark.createDataFrame([], "relation string, tuples long")


def sarif_rows(findings: DataFrame) -> DataFrame:
    """Findings (rule, message, file, line) to SARIF result objects, one JSON text a row."""
    region = F.struct(F.greatest(F.col("line").cast("long"), F.lit(1)).alias("startLine"))
    place = F.struct(F.struct(F.struct(F.col("file").alias("uri")).alias("artifactLocation"), region.alias("region")).alias("physicalLocation"))
    return findings.select("rule", F.to_json(F.struct(F.col("rule").alias("ruleId"), F.struct(F.col("message").alias("text")).alias("message"), F.array(place).alias("locations"))).alias("result"))


def write_sarif(findings: DataFrame, path: str, tool: str = "tuplewright") -> None:
    """A SARIF log in parts: a head, a result a line in as many files as Spark makes, a tail is joined by ``read_sarif``."""
    sarif_rows(findings).select("result").write.mode("overwrite").text(path)


def read_sarif(spark: SparkSession, path: str, tool: str = "tuplewright") -> str:
    """The whole log as one JSON text, for results of a size that fits one."""
    results = ",".join(r[0] for r in spark.read.text(path).orderBy("value").collect())
    return f'{{"version":"2.1.0","$schema":"https://json.schemastore.org/sarif-2.1.0.json","runs":[{{"tool":{{"driver":{{"name":"{tool}"}}}},"results":[{results}]}}]}}'


def json_config(directives: DataFrame) -> DataFrame:
    """Directives (kind, type, member) to one JSON object a type with its sorted members by kind."""
    by_kind = directives.groupBy("type", "kind").agg(F.array_sort(F.collect_set("member")).alias("members"))
    entries = F.array_sort(F.collect_list(F.struct("kind", "members")))
    return by_kind.groupBy("type").agg(entries.alias("entries")).select("type", F.to_json(F.struct(F.col("type").alias("name"), F.map_from_entries("entries").alias("directives"))).alias("json"))


class Clock:
    """Seconds of each phase of a run."""

    def __init__(self) -> None:
        self.seconds: dict[str, float] = {}

    @contextmanager
    def phase(self, name: str):
        began = time.time()
        try:
            yield
        finally:
            self.seconds[name] = self.seconds.get(name, 0.0) + time.time() - began

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(k, float(v)) for k, v in self.seconds.items()], "phase string, seconds double")
