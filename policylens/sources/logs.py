"""Readers of decision logs: JSON lines, partitioned Parquet and uploads."""

from __future__ import annotations

import json
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from policylens.functions.pmf import once
from policylens.operators.joins import of_key
from policylens.operators.reports import in_window
from policylens.operators.validate import first_problem, validate_logged
from policylens.schema import KEY

RECORD = """
  decisionId string, tsMs bigint, context string, derived string,
  actions array<struct<id:string,features:string>>,
  pmf array<double>, chosen int, chosenIndex int, action string, probability double,
  reward double, rewards array<struct<seq:bigint,reward:double>>,
  targetPmf array<double>, mode string, bad string
"""
# The fields a logged row and a reward event may have.
ROW_FIELDS = [
    "decisionId", "tsMs", "context", "derived", "actions", "eligible", "pmf", "chosen",
    "chosenIndex", "action", "probability", "reward", "rewards", "targetPmf", "seed",
    "modelVersion", "mode", "reason", "requestSha256", "programSha256",
]
EVENT_FIELDS = [
    "seq", "tsMs", "reward", "rewardNormalized", "idempotencyKey", "detail",
]


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Text lines as `value`; the files split by Spark, never read whole."""
    return spark.read.text(path)


def clean_lines(lines: DataFrame) -> DataFrame:
    """Blank lines dropped and a byte-order mark removed; a line that is made by an expression is made once."""
    value = F.col("value")
    bare = F.when(value.startswith("\ufeff"), F.expr("substring(value, 2)")).otherwise(value).alias("value")
    return once(lines, *[bare if c == "value" else c for c in lines.columns]).filter(F.trim("value") != "")


def only_fields(keys: Column, allowed: list[str]) -> Column:
    return F.size(F.array_except(keys, F.array(*[F.lit(a) for a in allowed]))) == 0


def parse_logged_rows(lines: DataFrame, aggregation: str = "first") -> DataFrame:
    """Logged rows from JSON lines in either shape.

    Adds `problem`: NULL for a usable row, `legacy` for a row without propensities, or what is
    wrong with it.  Columns other than `value` are passed through.
    """
    if aggregation not in ("first", "sum"):
        raise ValueError("aggregation must be first or sum")
    extra = [c for c in lines.columns if c != "value"]
    doc = F.from_json("value", RECORD, {"columnNameOfCorruptRecord": "bad"})
    df = once(
        clean_lines(lines), *extra, doc.alias("r"), F.try_parse_json("value").alias("v"),
        F.json_object_keys("value").alias("keys"),
    )
    listed = F.try_variant_get("v", "$.eligible", "array<variant>")
    event_keys = F.transform(
        F.try_variant_get("v", "$.rewards", "array<map<string,variant>>"), lambda m: F.map_keys(m)
    )
    # what several rules read is evaluated once per row
    df = once(
        df, *extra, "r", "keys", F.schema_of_variant("v").alias("shape"), F.col("v").isNotNull().alias("json"),
        listed.alias("listed"), F.transform(listed, lambda x: F.schema_of_variant(x)).alias("kinds"),
        event_keys.alias("event_keys"),
    )
    by_id = F.exists("kinds", lambda k: k == "STRING")
    ids = F.col("r.actions.id")
    found = F.when(
        by_id,
        F.transform(
            F.col("listed"),
            lambda x: (F.array_position(ids, F.try_variant_get(x, "$", "string")) - 1).cast("int"),
        ),
    ).otherwise(F.transform(F.col("listed"), lambda x: F.try_variant_get(x, "$", "int")))
    df = once(
        df, *extra, "r", "keys", "shape", "json", "kinds", "event_keys", by_id.alias("by_id"), found.alias("positions"),
        F.array_sort(F.col("r.rewards")).alias("events"),
    )
    keys, kinds, by_id, positions, events, event_keys = map(
        F.col, ("keys", "kinds", "by_id", "positions", "events", "event_keys")
    )
    whole = F.forall(kinds, lambda k: k == "BIGINT")
    if aggregation == "first":
        folded = F.get(events, F.lit(0))["reward"]
    else:
        folded = F.when(
            F.size(events) > 0, F.aggregate(events, F.lit(0.0), lambda s, e: s + e["reward"])
        )
    seqs = F.transform(F.col("r.rewards"), lambda e: e["seq"])
    chosen = F.coalesce("r.chosen", "r.chosenIndex")
    named = F.get(ids, chosen)
    shape = first_problem(
        [
            ("not_json", F.col("json")),
            ("not_an_object", F.col("shape").startswith("OBJECT")),
            ("unknown_field", only_fields(keys, ROW_FIELDS)),
            ("wrong_type", F.col("r.bad").isNull()),
            ("id_missing", F.col("r.decisionId").isNotNull()),
            ("pmf_missing", F.array_contains(keys, "pmf")),
            ("actions_missing", F.col("r.actions").isNotNull()),
            ("chosen_missing", chosen.isNotNull()),
            (
                "eligible_invalid",
                F.when(by_id, F.forall(kinds, lambda k: k == "STRING")).otherwise(whole),
            ),
            (
                "eligible_unknown_id",
                F.forall(positions, lambda p: F.coalesce(p, F.lit(-1)) >= 0)
                | (F.coalesce(by_id, F.lit(False)) == F.lit(False)),
            ),
            ("action_mismatch", F.col("r.action").isNull() | (F.col("r.action") == named)),
            (
                "reward_field_unknown",
                event_keys.isNull() | F.forall(event_keys, lambda k: only_fields(k, EVENT_FIELDS)),
            ),
            ("reward_seq_repeated", seqs.isNull() | (F.size(F.array_distinct(seqs)) == F.size(seqs))),
        ]
    )
    from_events = F.col("r.reward").isNull() & folded.isNotNull()
    rows = once(
        df,
        *extra,
        F.col("r.decisionId").alias("id"),
        F.coalesce("r.tsMs", F.lit(0)).alias("ts_ms"),
        F.coalesce("r.mode", F.lit("learner")).alias("mode"),
        F.col("r.context").alias("context"),
        F.col("r.derived").alias("derived"),
        F.col("r.actions").alias("actions"),
        positions.alias("eligible"),
        F.col("r.pmf").alias("pmf"),
        chosen.alias("chosen_index"),
        named.alias("chosen_id"),
        F.col("r.probability").alias("probability"),
        F.coalesce(F.col("r.reward"), folded).alias("reward"),
        from_events.alias("aggregated"),
        F.col("r.targetPmf").alias("target_pmf"),
        shape.alias("shape_problem"),
    )
    checked = validate_logged(rows)
    problem = F.coalesce("shape_problem", "problem").alias("problem")
    kept = [c for c in checked.columns if c not in ("problem", "shape_problem")]
    return once(checked, *kept, problem)


def read_logged_rows(
    spark: SparkSession, path: str, key: tuple[str, str, str], aggregation: str = "first"
) -> DataFrame:
    """`parse_logged_rows` of the files at `path`, under one capsule key."""
    lines = read_lines(spark, path)
    for name, value in zip(KEY, key, strict=True):
        lines = lines.withColumn(name, F.lit(value))
    return parse_logged_rows(lines, aggregation)


def write_event_log(df: DataFrame, path: str, mode: str = "append") -> None:
    """Parquet partitioned by key and day, so key and time filters skip files.

    Tasks take ranges of (key, day, time): a folder gets few files, each with a narrow range of times,
    and a day with very many rows is several tasks' work.
    """
    day = F.to_date(F.timestamp_millis("ts_ms")).alias("day")
    (
        df.withColumn("day", day)
        .repartitionByRange(*KEY, "day", "ts_ms")
        .sortWithinPartitions(*KEY, "day", "ts_ms", *(["id"] if "id" in df.columns else []))
        .write.mode(mode)
        .partitionBy(*KEY, "day")
        .parquet(path)
    )


def read_event_log(
    spark: SparkSession, path: str, key: tuple[str, str, str] | None = None,
    since_ms: int | None = None, until_ms: int | None = None,
) -> DataFrame:
    """One capsule's rows with ts_ms in [since, until).

    The key and the day prune folders; the exact bounds are pushed to the scan.
    """
    df = spark.read.parquet(path)
    if key is not None:
        df = df.filter(of_key(key))
    if "day" in df.columns:
        if since_ms is not None:
            df = df.filter(F.col("day") >= F.to_date(F.timestamp_millis(F.lit(since_ms))))
        if until_ms is not None:
            df = df.filter(F.col("day") <= F.to_date(F.timestamp_millis(F.lit(until_ms - 1))))
        df = df.drop("day")
    return in_window(df, since_ms, until_ms)


UPLOAD_DECISION = (
    "decisionId string, tsMs bigint, modelTag string, modelVersion bigint, seed string, "
    "input string, chosenIndex int, chosenId string, probability double, "
    "pmf array<double>, eligible array<int>"
)
UPLOAD_REWARD = "decisionId string, reward double, value double, idempotencyKey string, detail string"
UPLOAD_FIELDS = [
    "decisionId", "tsMs", "modelTag", "modelVersion", "seed", "input", "chosenIndex",
    "chosenId", "probability", "pmf", "eligible",
]
INPUT = (
    "context string, actions array<struct<id:string,features:string>>, "
    "excludedActions array<string>, baselineAction string"
)
INPUT_FIELDS = ["context", "actions", "excludedActions", "baselineAction"]


#: Characters of a line, and characters and brackets of an item, up to which `plain_items` reads: well inside the limits of
#: Spark's JSON reader.  Digits in a row from which a number is not kept as it is.
PLAIN_LINE, PLAIN_ITEM, PLAIN_BRACKETS, PLAIN_DIGITS = 4 << 20, 40_000, 900, 38
DIGITS = bytes.maketrans(b"123456789", b"000000000")


def _real(text: str) -> float:
    # a variant writes 1.0 as 1, and exponents are left to Java
    value = float(text)
    if text[-1] == "0" or "e" in text or "E" in text or abs(value) >= 1e16:
        raise ValueError(text)
    return value


def _constant(text: str) -> None:
    raise ValueError(text)


def plain_items(value: Column) -> Column:
    """The items of upload lines, each as the text that `to_json` makes of its variant, and whether all its fields, and all
    those of its input, are known ones.

    Null for a line that is not plain; such a line is left to Spark's variants, which make a JSON writer for every key
    they write.  Plain is what a writer without blanks gives: ASCII without escapes, no key twice, numbers in their
    shortest form without exponent.  Of such a line a variant changes the order of keys only.  Whatever else reading and
    writing would change (blanks, keys given twice, longer numbers) makes the text shorter, so equal lengths tell.
    """
    fields, input_fields = frozenset(UPLOAD_FIELDS), frozenset(INPUT_FIELDS)

    @F.arrow_udf("array<struct<text:string,known:boolean,input_known:boolean>>")
    def read(lines: pa.Array) -> pa.Array:
        load = json.JSONDecoder(parse_float=_real, parse_constant=_constant).decode
        dump = json.JSONEncoder(sort_keys=True, separators=(",", ":"), ensure_ascii=False, check_circular=False).encode
        long_number = b"0" * (PLAIN_DIGITS + 1)

        def plain(line: str | None) -> list[tuple[str, bool, bool]] | None:
            if line is None or len(line) > PLAIN_LINE or not line.isascii() or "\\" in line:
                return None
            if long_number in line.encode().translate(DIGITS):
                return None
            try:
                doc = load(line)
            except (ValueError, RecursionError):
                return None
            items = doc.get("decisions") if type(doc) is dict and len(doc) == 1 else None
            if type(items) is not list:
                return None
            out, size = [], len('{"decisions":[]}') + max(len(items) - 1, 0)
            for item in items:
                if type(item) is not dict or type(item.get("input")) is not dict:
                    return None
                text = dump(item)
                if len(text) > PLAIN_ITEM or text.count("{") + text.count("[") > PLAIN_BRACKETS:
                    return None
                size += len(text)
                out.append((text, item.keys() <= fields, item["input"].keys() <= input_fields))
            return out if size == len(line) else None

        got = [plain(line) for line in lines.to_pylist()]
        flat = [item for items in got if items is not None for item in items]
        text, known, input_known = zip(*flat, strict=True) if flat else ((), (), ())
        parts = [pa.array(text, pa.string()), pa.array(known, pa.bool_()), pa.array(input_known, pa.bool_())]
        ends = pa.array(accumulate((len(items or ()) for items in got), initial=0), pa.int32())
        entries = pa.StructArray.from_arrays(parts, ["text", "known", "input_known"])
        return pa.ListArray.from_arrays(ends, entries, mask=pa.array([items is None for items in got], pa.bool_()))

    return read(value)


def parse_uploaded_decisions(lines: DataFrame) -> DataFrame:
    """One row per item of JSON batches `{"decisions": [...]}`.

    Works on a batch or a streaming DataFrame of lines.  `seed` becomes the signed long with
    the same 64 bits.
    """
    extra = [c for c in lines.columns if c != "value"]
    items = F.try_variant_get(F.try_parse_json("value"), "$.decisions", "array<variant>")
    untold = F.lit(None).cast("boolean")
    other = F.transform(items, lambda i: F.struct(F.to_json(i).alias("text"), untold.alias("known"), untold.alias("input_known")))
    raw = once(clean_lines(lines), *extra, "value", plain_items(F.col("value")).alias("plain")).select(
        *extra, F.inline(F.when(F.col("plain").isNotNull(), F.col("plain")).otherwise(other))
    )
    # plain projections, which Spark compiles; the last one below is what filters are not pushed through
    parsed = raw.select(
        *extra,
        F.from_json("text", UPLOAD_DECISION).alias("d"),
        F.coalesce("known", only_fields(F.json_object_keys("text"), UPLOAD_FIELDS)).alias("known"), "input_known",
    ).select(
        *extra, "d", "known", F.from_json("d.input", INPUT).alias("i"),
        F.coalesce("input_known", only_fields(F.json_object_keys("d.input"), INPUT_FIELDS)).alias("input_known"),
        F.try_to_number(F.col("d.seed"), F.lit("99999999999999999999")).alias("seed_number"),
    )
    seed = F.col("seed_number")
    top = F.lit("9223372036854775808").cast("decimal(20,0)")
    signed = F.when(seed < top, seed).otherwise(seed - top - top).cast("bigint")
    has_object = F.col("i.context").isNull() | F.col("i.context").startswith("{")
    return once(
        parsed,
        *extra,
        F.col("d.decisionId").alias("id"),
        F.col("d.tsMs").alias("ts_ms"),
        F.col("d.modelTag").alias("model_tag"),
        F.col("d.modelVersion").alias("model_version"),
        signed.alias("seed"),
        F.when(
            F.col("i.context").isNull() | (F.col("i.context") == "null"), "{}"
        ).otherwise(F.col("i.context")).alias("context"),
        F.col("i.actions").alias("actions"),
        F.col("i.excludedActions").alias("excluded_ids"),
        F.col("i.baselineAction").alias("baseline"),
        F.col("d.chosenIndex").alias("chosen_index"),
        F.col("d.chosenId").alias("chosen_id"),
        F.col("d.probability").alias("probability"),
        F.col("d.pmf").alias("pmf"),
        F.col("d.eligible").alias("eligible"),
        F.sha2(F.coalesce("d.input", F.lit("null")), 256).alias("request_sha256"),
        first_problem(
            [
                ("unknown_field", F.col("known")),
                ("id_missing", F.col("d.decisionId").isNotNull()),
                ("ts_missing", F.col("d.tsMs").isNotNull()),
                ("tag_missing", F.col("d.modelTag").isNotNull()),
                ("seed_invalid", signed.isNotNull()),
                ("input_field_unknown", F.col("input_known")),
                ("context_not_object", has_object),
                ("chosen_missing", F.col("d.chosenIndex").isNotNull()),
                ("pmf_missing", F.col("d.pmf").isNotNull()),
                ("eligible_missing", F.col("d.eligible").isNotNull()),
                ("probability_missing", F.col("d.probability").isNotNull()),
            ]
        ).alias("problem"),
    )


def parse_uploaded_rewards(lines: DataFrame) -> DataFrame:
    """One row per item of JSON batches `{"rewards": [...]}`, with its `position` in the batch.

    An item that is no reward record has an `item_problem` and does not spoil the items beside it.
    """
    extra = [c for c in lines.columns if c != "value"]
    items = F.try_variant_get(F.try_parse_json("value"), "$.rewards", "array<variant>")
    raw = clean_lines(lines).select(*extra, F.posexplode(F.transform(items, lambda i: F.to_json(i))).alias("position", "text"))
    parsed = once(raw, *extra, "position", F.from_json("text", UPLOAD_REWARD).alias("d"), F.json_object_keys("text").alias("fields"))
    value = F.coalesce("d.reward", "d.value")
    return parsed.select(
        *extra, "position", F.col("d.decisionId").alias("decision_id"), value.alias("value"), F.col("d.idempotencyKey").alias("given_key"),
        F.col("d.detail").alias("detail"),
        first_problem([
            ("no_reward_record", F.col("fields").isNotNull()),
            ("unknown_field", only_fields(F.col("fields"), [f.split(" ")[0] for f in UPLOAD_REWARD.split(", ")])),
            ("decision_id_missing", F.col("d.decisionId").isNotNull()),
            ("value_missing", value.isNotNull()),
        ]).alias("item_problem"),
    )


def stream_lines(spark: SparkSession, path: str, max_files: int = 100) -> DataFrame:
    """Uploaded batches as a stream of lines."""
    return spark.readStream.option("maxFilesPerTrigger", max_files).text(path)
