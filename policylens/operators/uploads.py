"""Verification of client-made decisions by replay."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from policylens.functions.features import featurize, restrict
from policylens.operators.joins import with_model
from policylens.operators import specs as P
from policylens.operators.learner import decide
from policylens.operators.validate import event_id_ok, pmf_ok, upload_window, yes
from policylens.schema import KEY, PROBABILITY_TOLERANCE
from policylens.session import written
from policylens.spec import PolicySpec

SAME = ["request_sha256", "seed", "chosen_index"]


def consistent() -> Column:
    """What an upload must satisfy even when its model is gone."""
    position = F.array_position("eligible", F.col("chosen_index")).cast("int") - 1
    size = F.size("actions")
    ascending = F.array_sort("eligible") == F.col("eligible")
    named = F.get("actions", F.col("chosen_index"))["id"]
    return yes(
        (F.size("eligible") > 0)
        & F.forall("eligible", lambda i: (i >= 0) & (i < size))
        & (F.size(F.array_distinct("eligible")) == F.size("eligible"))
        & ascending
        & pmf_ok(F.col("pmf"), F.size("eligible"))
        & (F.abs(F.get("pmf", position) - F.col("probability")) <= PROBABILITY_TOLERANCE)
        & (F.col("probability") > 0)
        & (F.col("chosen_id").isNull() | (F.col("chosen_id") == named))
    )


def restriction_problem_of_upload() -> Column:
    """`unknown_action` or `nothing_eligible` by the exclusions of an upload; null for a valid one."""
    ids, excluded = F.transform("actions", lambda a: a["id"]), F.coalesce("excluded_ids", F.array().cast("array<string>"))
    return F.when(F.exists(excluded, lambda n: ~F.array_contains(ids, n)), "unknown_action").when(
        F.size(F.array_except(ids, excluded)) < 1, "nothing_eligible"
    )


def _same(side: str) -> Column:
    """Whether an upload is the decision of the columns with this prefix."""
    same = F.lit(True)
    for c in SAME:
        same = same & F.col(c).eqNullSafe(F.col(f"{side}_{c}"))
    return same


def verify_uploads(
    uploads: DataFrame, stored: DataFrame, models: DataFrame, slots: DataFrame,
    spec: PolicySpec | DataFrame, now_ms: int,
) -> DataFrame:
    """Adds `status` (new, unverified, duplicate or rejected) and `why` to every upload.

    `uploads` comes from `parse_uploaded_decisions` with KEY and `arrival`; `models` holds KEY,
    model_tag and n_updates of the published models and `slots` their slot rows by KEY and
    model_tag; `spec` is one spec or a spec table.  Each decision is scored and drawn again on the model its tag names.
    """
    spec = P.once(spec)
    declared = F.from_json(F.col("settings.declared"), "array<struct<id:string,features:string>>")
    up = P.with_settings(uploads, spec).withColumn("actions", F.coalesce("actions", declared)).drop("settings")
    up = upload_window(up, now_ms)
    taken = stored.select(*KEY, "id", *[F.col(c).alias(f"stored_{c}") for c in SAME])
    up = up.join(taken, [*KEY, "id"], "left")
    repeat = F.col("stored_request_sha256").isNotNull()
    up = up.withColumn("repeat", repeat).withColumn("same", _same("stored")).drop(
        *[f"stored_{c}" for c in SAME]
    )
    known = with_model(up, models.select(*KEY, "model_tag", F.col("n_updates").alias("version")))
    known = known.withColumn(
        "early",
        F.when(F.col("problem").isNotNull(), F.col("problem"))
        .when(~event_id_ok(F.col("id")), "event_id_invalid")
        .when(F.col("repeat") & ~F.col("same"), "id_used_by_other_decision")
        .when(F.col("repeat"), "duplicate")
        .when(~F.col("on_time"), "outside_upload_window")
        .when(
            F.col("version").isNull(),
            F.when(consistent(), "unverified").otherwise("inconsistent"),
        )
        .when(
            F.col("model_version").isNotNull() & (F.col("model_version") != F.col("version")),
            "version_mismatch",
        )
        .otherwise(
            restriction_problem_of_upload()  # what names no action, or leaves none, is refused before the replay
        ),
    )
    # used several times below; what goes with a verdict is then found by the number of its row
    known = written(known.withColumn("row_", F.monotonically_increasing_id()), "uploads")
    work = known.filter(F.col("early").isNull()).select(
        *KEY, "model_tag", "id", "arrival", "seed", "context", F.lit("{}").alias("derived"),
        "actions", "excluded_ids", *(["baseline"] if "baseline" in known.columns else []),
    )
    # what made the features stays behind: of an action the replay needs the id only
    ready = featurize(restrict(work)).drop("context", "derived", "excluded_ids").withColumn(
        "actions", F.transform("actions", lambda a: F.struct(a["id"].alias("id")))
    )
    replayed = decide(
        ready, slots, models, spec,
        model_key=[*KEY, "model_tag"], row_id=["id", "arrival"],
    ).select(
        *KEY, "id", "arrival",
        F.col("eligible").alias("r_eligible"), F.col("pmf").alias("r_pmf"),
        F.col("chosen_index").alias("r_chosen"), F.col("probability").alias("r_probability"),
    )
    close = F.forall(
        F.zip_with("pmf", "r_pmf", lambda a, b: yes(F.abs(a - b) <= PROBABILITY_TOLERANCE)),
        lambda ok: ok,
    )
    replays = yes(
        (F.col("eligible") == F.col("r_eligible"))
        & (F.col("chosen_index") == F.col("r_chosen"))
        & (F.size("pmf") == F.size("r_pmf"))
        & close
        & (F.abs(F.col("probability") - F.col("r_probability")) <= PROBABILITY_TOLERANCE)
    )
    # rows that were refused before the replay, and all that the replay does not compare, stay where they are
    sent = known.filter(F.col("early").isNull()).select(
        "row_", *KEY, "id", "arrival", "request_sha256", "seed", "eligible", "pmf", "chosen_index", "probability"
    )
    verdict = written(
        sent.join(replayed, [*KEY, "id", "arrival"], "left").select("row_", *KEY, "id", "arrival", *SAME, replays.alias("replays")),
        "verdicts",
    )
    early = known.filter(F.col("early").isNotNull()).withColumn("replays", F.lit(False))
    judged = early.unionByName(known.filter(F.col("early").isNull()).join(verdict.select("row_", "replays"), "row_"))
    status = (
        F.when(F.col("early").isin("duplicate", "unverified"), F.col("early"))
        .when(F.col("early").isNotNull(), "rejected")
        .when(F.col("replays"), "new")
        .otherwise("rejected")
    )
    why = F.when(status == "rejected", F.coalesce("early", F.lit("does_not_replay")))
    left = [c for c in known.columns if c not in (*KEY, "id", "arrival", "row_", "early", "repeat", "same")]
    judged = judged.select(*KEY, "id", "arrival", *left, status.alias("status"), why.alias("why"))
    # an id belongs to the first upload of it that is accepted; later ones repeat that
    first = [*KEY, "id", "arrival", *SAME]
    accepted = verdict.filter("replays").select(*first).unionByName(early.filter(F.col("early") == "unverified").select(*first))
    claims = accepted.groupBy(*KEY, "id").agg(
        F.min("arrival").alias("claim_arrival"),
        F.min_by(F.struct(*[F.col(c).alias(f"claim_{c}") for c in SAME]), "arrival").alias("f"),
    ).select(*KEY, "id", "claim_arrival", "f.*")
    unreadable = F.col("problem").isNotNull() | (F.col("why") == "event_id_invalid")
    later = (F.col("arrival") > F.col("claim_arrival")) & ~F.coalesce(unreadable, F.lit(False))
    return (
        judged.join(claims, [*KEY, "id"], "left")
        .withColumn("later", F.coalesce(later, F.lit(False)))
        .withColumn("same", _same("claim"))
        .withColumn(
            "status",
            F.when(F.col("later"), F.when(F.col("same"), "duplicate").otherwise("rejected")).otherwise(F.col("status")),
        )
        .withColumn(
            "why",
            F.when(F.col("later"), F.when(~F.col("same"), "id_used_by_other_decision")).otherwise(F.col("why")),
        )
        .drop("later", "same", "claim_arrival", *[f"claim_{c}" for c in SAME])
    )
