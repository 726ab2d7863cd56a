"""Requests and feature lists: one query over one geometry or many, with the status rules of the service."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import QueryParseError
from ..plans.catalog import Catalog
from ..plans.engine import Engine
from ..sources.sinks import cache_key, to_csv, to_records
from ..sources.store import ResultStore
from .masks import distinct_shapes, polygons


def run_request(spark: SparkSession, request: dict, pixels: DataFrame | dict[str, DataFrame]) -> dict:
    """The envelope of one request (query or sql, geometry, environment, format): success, failed or error."""
    try:
        text = request.get("query") or request["sql"]
        out = Engine(spark, Catalog.of(request["environment"]), pixels).sql(text, request["geometry"])
        data = to_csv(out) if request.get("format", "json") == "csv" else to_records(out)
    except QueryParseError as e:
        return {"status": "failed", "message": str(e)}
    except Exception as e:  # the envelope reports every other error
        return {"status": "error", "message": str(e)}
    return {"status": "success", "data": data}


def load_features(spark: SparkSession, feature_collection: dict | None = None, uri: str | None = None, ids: Iterable[str] | None = None, resolver: Callable[[list[str]], DataFrame] | None = None, id_field: str = "fid", csv: str | None = None) -> DataFrame:
    """Features (fid, geometry as GeoJSON text) of exactly one source.

    feature_collection: a dict; uri: a file of a feature collection; csv: files with a header, the columns fid and geometry,
    and quotes doubled inside quotes; ids: names that a resolver turns into such a table, each exactly once.
    """
    if sum(x is not None for x in (feature_collection, uri, ids, csv)) != 1:
        raise ValueError("give exactly one of feature_collection, uri, ids and csv")
    if csv is not None:
        rows = spark.read.option("header", True).option("escape", '"').option("multiLine", True).csv(csv)
        if lacking := {id_field, "geometry"} - set(rows.columns):
            raise ValueError(f"the CSV lacks {sorted(lacking)}")
        return rows.select(F.col(id_field).alias("fid"), "geometry")
    if ids is not None:
        if resolver is None:
            raise ValueError("ids need a resolver")
        wanted = spark.createDataFrame([(str(x),) for x in dict.fromkeys(ids)], "fid string")
        found = resolver([r for r in dict.fromkeys(map(str, ids))]).select(F.col("fid").cast("string"), "geometry").dropDuplicates(["fid"])
        return wanted.join(found, "fid", "left")  # an id without a geometry fails alone
    if feature_collection is not None:
        import json

        rows = []
        for f in feature_collection["features"]:
            key = f.get("properties", {}).get(id_field, f.get("id"))
            if key is None:
                raise ValueError(f"a feature lacks {id_field}")
            rows.append((str(key), json.dumps(f.get("geometry"))))
        return spark.createDataFrame(rows, "fid string, geometry string")
    whole = spark.read.text(uri, wholetext=True)
    feature = F.explode(F.from_json(F.get_json_object("value", "$.features"), "array<string>")).alias("f")
    key = F.coalesce(F.get_json_object("f", f"$.properties.{id_field}"), F.get_json_object("f", "$.id"))
    return whole.select(feature).select(key.alias("fid"), F.get_json_object("f", "$.geometry").alias("geometry"))


def feature_status(features: DataFrame) -> DataFrame:
    """(fid, status, detail): a feature with an unusable geometry fails alone."""
    bad = F.col("rings").isNull()
    return polygons(features).select("fid", F.when(bad, "failed").otherwise("success").alias("status"), F.when(bad, "the geometry must be a Polygon or MultiPolygon").alias("detail"))


def batch_status(status: DataFrame) -> DataFrame:
    """One row: success, partial_success, failed, or error where there is no feature; and the counts."""
    good, bad = F.count_if(F.col("status") == "success"), F.count_if(F.col("status") != "success")
    out = status.agg(good.alias("succeeded"), bad.alias("failed"))
    s, f = F.col("succeeded") > 0, F.col("failed") > 0
    return out.select(F.when(s & f, "partial_success").when(s, "success").when(f, "failed").otherwise("error").alias("status"), "succeeded", "failed")


def envelopes(engine: Engine, query: str, features: DataFrame) -> DataFrame:
    """(fid, status, message, data): one row per feature; data holds its result rows as a JSON array.

    The query is parsed once: if it is invalid all features fail. A feature with an unusable geometry fails alone.
    """
    keyed, shapes = distinct_shapes(features)
    status = feature_status(shapes).select("fid", "status", F.col("detail").alias("message"))
    try:
        q = engine.analyse(query)[0]
        out = engine.ordered(engine.sql_shapes(q, shapes), q, ["fid"])
    except QueryParseError as e:
        return features.select("fid", F.lit("failed").alias("status"), F.lit(str(e)).alias("message"), F.lit(None).cast("string").alias("data"))
    row = F.struct(F.monotonically_increasing_id().alias("_at"), F.struct(*(f"`{c}`" for c in out.columns[1:])).alias("row"))
    rows = out.select("fid", row.alias("r")).groupBy("fid").agg(F.to_json(F.transform(F.sort_array(F.collect_list("r")), lambda r: r["row"]), {"ignoreNullFields": "false"}).alias("data"))
    good = F.col("status") == "success"
    told = status.join(rows, "fid", "left").withColumn("data", F.when(good, F.coalesce("data", F.lit("[]"))))
    return keyed.join(told.withColumnRenamed("fid", "_shape"), "_shape").drop("_shape")


def stored_many(engine: Engine, query: str, features: DataFrame, root: str, lifetime: float = 172_800) -> DataFrame:
    """What sql_many gives, through a store: only features without a stored result are evaluated, and then kept.

    The store is keyed by geometry under a folder of the query and the environment, so equal geometries share a result.
    """
    store = ResultStore(engine.spark, f"{root.rstrip('/')}/{cache_key(query, engine.catalog.dump())}", lifetime)
    keyed = features.select("fid", "geometry", F.sha2("geometry", 256).alias("key"))
    distinct = keyed.groupBy("key").agg(F.min("geometry").alias("geometry"))
    new = store.missing(distinct).select(F.col("key").alias("fid"), "geometry")
    if not new.isEmpty():
        states = feature_status(new).select(F.col("fid").alias("key"), F.when(F.col("status") == "success", "success").otherwise("error").alias("state"), F.col("detail").alias("message"))
        store.save(engine.sql_many(query, new).withColumnRenamed("fid", "key"), states)
    return keyed.select("fid", "key").join(store.get(keyed), "key").drop("key")


def write_batch(engine: Engine, query: str, features: DataFrame, path: str) -> dict:
    """Results and failed features as JSON tables under path; the batch's status and the two places."""
    status = feature_status(features)
    engine.sql_many(query, features).write.mode("overwrite").json(f"{path}/analysis_results")
    status.where("status <> 'success'").write.mode("overwrite").json(f"{path}/failed_geometries")
    row = batch_status(status).first()
    return {"status": row["status"], "query": query, "data": {"results": f"{path}/analysis_results", "failed_geometries": f"{path}/failed_geometries"}}
