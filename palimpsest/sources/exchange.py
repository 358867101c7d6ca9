"""Moving a store in and out: lossless JSON, packs with a manifest, public benchmark formats, growth documents."""

from __future__ import annotations

import hashlib
import hmac
import json
from collections.abc import Iterator
from datetime import UTC, datetime

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

FORMAT, VERSION = "memory-store", 3


def pack_vector(v: Column) -> Column:
    """A float vector as base64 of little-endian float32, in an Arrow batch."""

    @F.pandas_udf(T.StringType())
    def enc(s: pd.Series) -> pd.Series:
        import base64

        import numpy as np

        return s.map(lambda x: None if x is None else base64.b64encode(np.asarray(x, "<f4").tobytes()).decode())

    return enc(v)


def unpack_vector(c: Column) -> Column:
    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def dec(s: pd.Series) -> pd.Series:
        import base64

        import numpy as np

        return s.map(lambda x: None if x is None else np.frombuffer(base64.b64decode(x), "<f4"))

    return dec(c)


def export_json(df: DataFrame, path: str, vector: str | None = "emb") -> None:
    """One JSON object a row; a vector column becomes base64 text, so it comes back bit by bit."""
    out = df.withColumn(vector, pack_vector(F.col(vector))) if vector and vector in df.columns else df
    out.write.mode("overwrite").json(path)


def import_json(spark: SparkSession, path: str, schema: T.StructType, vector: str | None = "emb", key: str = "id") -> DataFrame:
    """Strict reading: a row that does not fit the schema, or lacks its key, fails the read."""
    text = T.StructType([T.StructField(f.name, T.StringType() if f.name == vector else f.dataType) for f in schema.fields])
    df = spark.read.schema(text).option("mode", "FAILFAST").json(path)
    df = df.withColumn(key, F.when(F.col(key).isNull(), F.raise_error(F.lit(f"row without {key}"))).otherwise(F.col(key)))
    return df.withColumn(vector, unpack_vector(F.col(vector))) if vector and vector in df.columns else df


def content_digest(df: DataFrame) -> str:
    """A digest of a table that does not depend on the order of its rows: the sum of row hashes, and their number."""
    row = F.xxhash64(*[F.col(c) for c in sorted(df.columns)]).cast("decimal(38,0)")
    got = df.agg(F.count("*").alias("n"), F.coalesce(F.sum(row), F.lit(0)).alias("s")).first()
    return hashlib.sha256(f"{got['n']}|{got['s']}".encode()).hexdigest()


def build_pack(tables: dict[str, DataFrame], path: str, name: str, audience: str, expires_at: str | None = None, secret: bytes | None = None) -> dict:
    """Write the tables and a manifest with their digests, signed if a secret is given."""
    spark = next(iter(tables.values())).sparkSession
    digests = {}
    for t, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{t}")
        digests[t] = content_digest(spark.read.parquet(f"{path}/{t}"))
    manifest = {"format": FORMAT, "version": VERSION, "name": name, "audience": audience, "expires_at": expires_at, "digests": digests}
    if secret:
        manifest["signature"] = hmac.new(secret, _canonical(manifest), hashlib.sha256).hexdigest()
    spark.createDataFrame([(json.dumps(manifest),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/manifest")
    return manifest


def open_pack(spark: SparkSession, path: str, secret: bytes | None = None, now: str | None = None) -> dict[str, DataFrame]:
    """Verify format, expiry, signature and digests, then give the tables; any doubt is an error."""
    manifest = json.loads("".join(r["value"] for r in spark.read.text(f"{path}/manifest").limit(10_000).collect()))
    if (manifest.get("format"), manifest.get("version")) != (FORMAT, VERSION):
        raise ValueError("unknown format of pack")
    if manifest.get("expires_at") and manifest["expires_at"] <= (now or datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")):
        raise ValueError("the pack has expired")
    signature = manifest.pop("signature", None)
    if secret and not hmac.compare_digest(signature or "", hmac.new(secret, _canonical(manifest), hashlib.sha256).hexdigest()):
        raise ValueError("the signature does not fit")
    out = {t: spark.read.parquet(f"{path}/{t}") for t in manifest["digests"]}
    for t, df in out.items():
        if content_digest(df) != manifest["digests"][t]:
            raise ValueError(f"the digest of {t} does not fit")
    return out


def _canonical(x: dict) -> bytes:
    return json.dumps(x, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()


def locomo(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns and questions of conversations with ``session_N`` lists: ``value`` holds one JSON conversation a row."""

    def turns(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            rows = []
            for v in pdf["value"]:
                x = json.loads(v)
                conv = x.get("conversation", {})
                for n in sorted(int(k[8:]) for k in conv if k.startswith("session_") and k[8:].isdigit()):
                    for i, t in enumerate(conv[f"session_{n}"] or []):
                        text = t.get("text", "") + (f" [shares {t['blip_caption']}]" if t.get("blip_caption") else "")
                        rows.append((x.get("sample_id"), f"session_{n}", conv.get(f"session_{n}_date_time"), i, t.get("speaker"), t.get("dia_id"), f"{t.get('speaker')}: {text}"))
            if rows:
                yield pd.DataFrame(rows, columns=["sample_id", "session_id", "at", "turn", "speaker", "dia_id", "content"])

    t = raw.select("value").mapInPandas(turns, "sample_id string, session_id string, at string, turn bigint, speaker string, dia_id string, content string")
    qa = T.ArrayType(T.StructType([T.StructField("question", T.StringType()), T.StructField("answer", T.StringType()), T.StructField("category", T.IntegerType()), T.StructField("evidence", T.ArrayType(T.StringType()))]))
    q = raw.select(F.get_json_object("value", "$.sample_id").alias("sample_id"), F.posexplode(F.from_json(F.get_json_object("value", "$.qa"), qa)).alias("n", "q"))
    ids = F.flatten(F.transform("q.evidence", lambda e: F.regexp_extract_all(e, F.lit(r"(D\d+:\d+)"), F.lit(1))))
    return t, q.select("sample_id", "n", "q.question", "q.answer", "q.category", ids.alias("evidence"))


def long_memory(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns and questions of items with parallel haystack lists; an item whose lists differ in length is an error."""
    turn = T.StructType([T.StructField("role", T.StringType()), T.StructField("content", T.StringType()), T.StructField("has_answer", T.BooleanType())])
    item = T.StructType([T.StructField(n, T.StringType()) for n in ("question_id", "question_type", "question", "answer", "question_date")] + [
        T.StructField("haystack_dates", T.ArrayType(T.StringType())), T.StructField("haystack_session_ids", T.ArrayType(T.StringType())),
        T.StructField("haystack_sessions", T.ArrayType(T.ArrayType(turn))), T.StructField("answer_session_ids", T.ArrayType(T.StringType()))])
    x = raw.select(F.from_json("value", item).alias("i")).select("i.*")
    same = (F.size("haystack_dates") == F.size("haystack_session_ids")) & (F.size("haystack_dates") == F.size("haystack_sessions"))
    x = x.withColumn("question_id", F.when(same, F.col("question_id")).otherwise(F.raise_error(F.lit("haystack lists differ in length")).cast("string")))
    s = x.select("question_id", F.explode(F.arrays_zip("haystack_session_ids", "haystack_dates", "haystack_sessions")).alias("s"))
    turns = s.select("question_id", F.col("s.haystack_session_ids").alias("session_id"), F.col("s.haystack_dates").alias("at"), F.posexplode("s.haystack_sessions").alias("turn", "t")).select("question_id", "session_id", "at", "turn", "t.*")
    return turns, x.select("question_id", "question_type", "question", "answer", "question_date", "answer_session_ids")
