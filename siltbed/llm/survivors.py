"""One surviving record per group of duplicates, chosen or built field by field.

Every copy votes for its value of every field. The copies are unpivoted to long rows, one
per field; a vote weighs the trust in its source times a decay with its age; votes for the
same normalised value are added up; per field the value with the most votes wins (max_by),
and the winners are pivoted back to one row per group.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Parts of a half-life are weighed in fixed point with so many bits, so that sums are exact whatever their order.
VOTE_BITS = 20


@dataclass(frozen=True)
class Field:
    """A field to be decided. ``value`` is its normalised value (no vote where NULL); ``trust`` a whole number from 0."""

    name: str
    value: Column
    trust: Column


def survivors(records: DataFrame, keys: dict[str, Column], identity: Column, fields: list[Field], rank: list[Column], age: Column | None = None, half_life: int = 1) -> DataFrame:
    """One row per group: the keys, a column per field, ``copies_differ`` (two different identities or more).

    ``identity`` tells copies apart: rows with the same identity are one copy and vote once
    (the vote of the highest rank counts). The weight of a vote is trust * 2^-(age /
    half_life), however old it is; without ``age`` there is no decay. The value with the
    largest sum wins; equal sums are decided by the highest ``rank`` among its voters
    (compared column by column, NULL lowest), then by the larger value (as text, if the
    fields have different types). A value may thus have trust 0 and still win if no other
    has votes. A field without any value is NULL. NULL trust counts as 0, negative or NULL
    age as no age. Records with a NULL key are left out; a NULL identity is an identity of
    its own. Fields may be of any type that can be cast to text and back. No records: no
    rows. Other columns are dropped, whatever their names.

    Nothing is gathered per group: copies are combined by (group, identity), then votes by
    (group, field, value) and half-lives, both with partial sums before the shuffle, and
    the winners by one row per task and group, so a group of any size is spread over all
    tasks. What is listed per value are the sums of its half-lives, one each, and these are
    added from the youngest on, so that sums of very old votes still differ.
    """
    names = [f"__k{i}" for i in range(len(keys))]
    types = records.select(*[f.value.alias(f.name) for f in fields]).schema
    same = len({types[f.name].dataType.simpleString() for f in fields}) == 1
    halvings = F.lit(0.0) if age is None else F.greatest(F.coalesce(age.cast("double"), F.lit(0.0)), F.lit(0.0)) / half_life
    picked = records.select(
        *[c.alias(n) for n, c in zip(names, keys.values(), strict=True)],
        identity.alias("__id"),
        F.struct(*rank).alias("__rank"),
        halvings.alias("__age"),
        *[(f.value if same else _to_bytes(f.value, types[f.name].dataType.typeName())).alias(f"__v{i}") for i, f in enumerate(fields)],
        *[F.greatest(F.coalesce(f.trust.cast("bigint"), F.lit(0)), F.lit(0)).alias(f"__t{i}") for i, f in enumerate(fields)],
    )
    for n in names:
        picked = picked.where(F.col(n).isNotNull())
    ballot = F.struct("__rank", "__age", *[f"__v{i}" for i in range(len(fields))], *[f"__t{i}" for i in range(len(fields))])
    copies = picked.select(*names, "__id", ballot.alias("__b")).groupBy(*names, "__id").agg(F.max("__b").alias("__b"))
    long = copies.select(
        *names,
        "__id",
        F.col("__b.__rank").alias("__rank"),
        F.col("__b.__age").alias("__age"),
        F.explode(F.array(*[F.struct(F.lit(i).cast("tinyint").alias("f"), F.col(f"__b.__v{i}").alias("v"), F.col(f"__b.__t{i}").alias("trust")) for i in range(len(fields))])).alias("__x"),
    ).select(*names, "__id", "__rank", "__age", "__x.*")
    told = [F.max("__rank").alias("__rank"), F.min("__low").alias("__low"), F.max("__high").alias("__high"), F.max("__none").alias("__none")]
    long = long.select("*", F.col("__id").alias("__low"), F.col("__id").alias("__high"), F.col("__id").isNull().alias("__none"))
    if age is None:
        values = long.groupBy(*names, "f", "v").agg(F.sum("trust").alias("votes"), *told)
    else:
        whole = F.floor("__age").cast("bigint")
        part = F.round(F.pow(F.lit(2.0), VOTE_BITS - (F.col("__age") - whole))).cast("bigint")
        halved = long.select("*", whole.alias("__halved"), (F.col("trust") * part).alias("__vote"))
        halved = halved.groupBy(*names, "f", "v", "__halved").agg(F.sum("__vote").alias("__votes"), *told)
        values = halved.groupBy(*names, "f", "v").agg(_total(F.collect_list(F.when(F.col("__votes") > 0, F.struct("__halved", "__votes")))).alias("votes"), *told)
    merit = F.struct("votes", "__rank", "v")
    winners = values.groupBy(*names).agg(
        *[F.max_by(F.when(F.col("f") == i, F.col("v")), F.when((F.col("f") == i) & F.col("v").isNotNull(), merit)).alias(f"__w{i}") for i in range(len(fields))],
        F.min("__low").alias("__low"),
        F.max("__high").alias("__high"),
        F.max("__none").alias("__none"),
    )
    differ = F.coalesce(F.col("__low") != F.col("__high"), F.lit(False)) | (F.col("__none") & F.col("__low").isNotNull())
    return winners.select(
        *[F.col(n).alias(k) for n, k in zip(names, keys, strict=True)],
        *[(F.col(f"__w{i}") if same else _from_bytes(F.col(f"__w{i}"), types[f.name].dataType)).alias(f.name) for i, f in enumerate(fields)],
        differ.alias("copies_differ"),
    )


def _total(sums: Column) -> Column:
    """The sum of votes * 2^-halved as (exponent, part from 1 to 2), which compares as numbers do and can't underflow."""
    young = F.sort_array(sums)
    least = F.get(young, F.lit(0))["__halved"]
    total = F.aggregate(young, F.lit(0.0), lambda t, s: t + s["__votes"] * F.pow(F.lit(2.0), least - s["__halved"]))
    guess = F.floor(F.log2(total))
    part = total / F.pow(F.lit(2.0), guess)
    low, high = part < 1, part >= 2  # a logarithm may be off by its last bit
    exponent = guess - least + F.when(high, 1).when(low, -1).otherwise(0)
    return F.struct(exponent.alias("exponent"), F.when(high, part / 2).when(low, part * 2).otherwise(part).alias("part"))


def _to_bytes(value: Column, kind: str) -> Column:
    return value if kind == "binary" else value.cast("string").cast("binary")


def _from_bytes(data: Column, kind) -> Column:
    return data if kind.typeName() == "binary" else data.cast("string").cast(kind)


# The record copies of the test tables


def _copies(slices: DataFrame, file_infos: DataFrame) -> DataFrame:
    """The slices with their true key, whether their value is complete and whether their file is live."""
    from siltbed.functions.keys import true_key
    from siltbed.operators.consolidate import present_files, record_bytes
    from siltbed.session import join_small

    key = true_key(F.col("key_"), F.col("key_length_"))
    rows = slices.select("rec_id", "db_name", "version_", "file_id_", "block_id_", "offset_", "data_length_", "value_", "seq_", "stored_at", key.alias("__key"))
    live = present_files(file_infos).where(F.col("file_status") == 0).select(F.col("file_id").alias("file_id_"), F.lit(True).alias("__live"))
    fits = (F.col("data_length_") == 0) | (F.col("data_length_") == record_bytes(F.col("__key"), F.col("value_")))
    complete = F.coalesce(F.col("value_").isNotNull() & fits, F.lit(False))
    joined = join_small(rows, live, ["file_id_"], "left")
    return joined.withColumn("__complete", complete).withColumn("__live", F.coalesce(F.col("__live"), F.lit(False)))


def best_copies(slices: DataFrame, file_infos: DataFrame) -> DataFrame:
    """(db_name, key, value_rec_id, slot_rec_id): from which copy a key's value and slot are taken.

    Every copy stands for itself, trusted fully or not at all: for the value if it is
    complete, for the slot only if its file is live. Equal votes are decided by
    (version, seq). Only keys with two different records or more come out.
    """
    rank = [F.coalesce(F.col("version_"), F.lit(0)), F.col("seq_")]
    fields = [
        Field("value_rec_id", F.col("rec_id"), F.col("__complete").cast("int")),
        Field("slot_rec_id", F.when(F.col("__live"), F.col("rec_id")), F.lit(1)),
    ]
    out = survivors(_copies(slices, file_infos), {"db_name": F.col("db_name"), "key": F.col("__key")}, F.col("rec_id"), fields, rank)
    return out.where("copies_differ").select("db_name", "key", "value_rec_id", F.coalesce("slot_rec_id", "value_rec_id").alias("slot_rec_id"))


#: Trust in a value or slot whose copy is sound, and in one that isn't.
SOUND, DOUBTFUL = 4, 1


def fused_records(slices: DataFrame, file_infos: DataFrame, as_of: str, half_life_days: int = 7) -> DataFrame:
    """(db_name, key, value_, slot, version_) built field by field from the votes of all copies.

    Trust is 4 for a complete value or a slot in a live file and 1 for any other; a copy's
    votes halve with every week between ``stored_at`` and ``as_of``. Version and slot
    numbers of 0 are unset and don't vote.
    """
    rank = [F.coalesce(F.col("version_"), F.lit(0)), F.col("seq_"), F.col("rec_id")]
    slot = F.concat_ws(":", F.col("file_id_").cast("string"), F.col("block_id_").cast("string"), F.col("offset_").cast("string"))
    fields = [
        Field("value_", F.col("value_"), F.when(F.col("__complete"), SOUND).otherwise(DOUBTFUL)),
        Field("slot", F.when(F.col("file_id_") > 0, slot), F.when(F.col("__live"), SOUND).otherwise(DOUBTFUL)),
        Field("version_", F.when(F.col("version_") > 0, F.col("version_")), F.lit(SOUND)),
    ]
    age = F.date_diff(F.lit(as_of).cast("date"), F.col("stored_at").cast("date"))
    out = survivors(_copies(slices, file_infos), {"db_name": F.col("db_name"), "key": F.col("__key")}, F.col("rec_id"), fields, rank, age, half_life_days)
    return out.where("copies_differ").drop("copies_differ")


def overruled(slices: DataFrame, file_infos: DataFrame, as_of: str, half_life_days: int = 7) -> DataFrame:
    """(db_name, keys, overruled): how many keys have copies that differ, and of how many the votes chose another value than the rank."""
    rank = [F.coalesce(F.col("version_"), F.lit(0)), F.col("seq_"), F.col("rec_id")]
    fields = [Field("voted", F.col("value_"), F.when(F.col("__complete"), SOUND).otherwise(DOUBTFUL)), Field("ranked", F.col("value_"), F.lit(0))]
    age = F.date_diff(F.lit(as_of).cast("date"), F.col("stored_at").cast("date"))
    out = survivors(_copies(slices, file_infos), {"db_name": F.col("db_name"), "key": F.col("__key")}, F.col("rec_id"), fields, rank, age, half_life_days)
    other = ~F.col("voted").eqNullSafe(F.col("ranked"))
    return out.where("copies_differ").groupBy("db_name").agg(F.count(F.lit(1)).alias("keys"), F.sum(other.cast("bigint")).alias("overruled"))
