"""Applying a feed of inserts, updates and deletes.

Every fold is a maximum or minimum of a struct that starts with the sequence
number. These are commutative, associative and idempotent, so late, repeated
and disordered records need no sort, Spark combines them map-side, and a key
with a third of all records costs one row per task in the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brackenfold.operators.skew import HOT_ROWS, lookup_join

# Operation names, their initials and their codes in the log.
OPERATIONS = {
    "insert": "I", "i": "I", "1": "I",
    "delete": "D", "d": "D", "2": "D",
    "update": "U", "u": "U", "3": "U",
    "checkpoint": "C", "c": "C", "4": "C",
}


def operation(op: Column) -> Column:
    """I, U, D or C for any way to write an operation; null for anything else."""
    name = F.lower(F.regexp_replace(op.cast("string"), r"(?U)^\s+|\s+$", ""))
    return F.create_map(*[F.lit(x) for pair in OPERATIONS.items() for x in pair])[name]


def _feed(changes: DataFrame, key: str, seq: str, op: str, base: DataFrame | None, state: DataFrame | None) -> DataFrame:
    """(key, seq, op) of the records that can have an effect, with op as I, U or D."""
    feed = changes.select(F.col(key), F.col(seq), operation(F.col(op)).alias("op"))
    if base is not None:
        feed = feed.unionByName(base.select(F.col(key), F.col(seq), F.lit("I").alias("op")))
    if state is not None:
        feed = feed.unionByName(state.select(key, seq, "op"))
    return feed.where(F.col(key).isNotNull() & F.col(seq).isNotNull() & F.col("op").isin("I", "U", "D"))


def _retained(feed: DataFrame, key: str, seq: str, hot_rows: int) -> DataFrame:
    """(key, seq, op): the records that the outcome may still depend on, whatever else arrives.

    Per key these are its last delete D, its last update after D, and its inserts
    after D: the first one counts now, a later one would if a delete between
    them came late. Everything before D is settled.
    """
    at = lambda o: F.max(F.when(F.col("op") == o, F.col(seq)))
    last = feed.groupBy(key).agg(at("D").alias("_d"), at("U").alias("_u"), F.count(F.when(F.col("op") == "I", 1)).alias("_n"))
    after = lambda c: F.when(F.col("_d").isNull() | (c > F.col("_d")), c)
    ends = last.select(key, F.explode(F.array(F.struct(F.col("_d").alias(seq), F.lit("D").alias("op")), F.struct(after(F.col("_u")).alias(seq), F.lit("U").alias("op")))).alias("_r")).select(key, f"_r.{seq}", "_r.op").where(F.col(seq).isNotNull())
    inserts = feed.where(F.col("op") == "I").select(key, seq)
    open_ = lookup_join(inserts, last.where(F.col("_n") > 0).select(key, "_d", "_n"), [key], "_n", hot_rows).where(after(F.col(seq)).isNotNull()).select(key, seq).distinct()
    return ends.unionByName(open_.withColumn("op", F.lit("I")))


def _live(retained: DataFrame, key: str, seq: str) -> DataFrame:
    """(key, seq): live keys and the last record that took effect, from retained records."""
    found = retained.groupBy(key).agg(F.min(F.when(F.col("op") == "I", F.col(seq))).alias("_i"), F.max(F.when(F.col("op") == "U", F.col(seq))).alias("_u"))
    return found.where(F.col("_i").isNotNull()).select(key, F.greatest("_i", F.when(F.col("_u") > F.col("_i"), F.col("_u"))).alias(seq))


def _filled(payload: list[str]) -> Column:
    return sum((F.col(c).isNotNull().cast("int") for c in payload), F.lit(0))


def effective_lsn(changes: DataFrame, key: str, seq: str, op: str, base: DataFrame | None = None, hot_rows: int = HOT_ROWS, state: DataFrame | None = None) -> DataFrame:
    """(key, seq): the keys that are live at the end and the last change that took effect.

    An insert takes effect on a key that isn't live, an update or delete on one
    that is. Per key, with D = last delete (a tombstone whether or not it had an
    effect: after it the key isn't live), I = first insert after D and U = last
    update: the key is live if I exists, and the last change in effect is U if
    U > I, else I.

    ``base`` (key, seq) holds rows that are live before the feed; each counts as
    an insert at its sequence number. ``state`` is what ``merged_state`` gave for
    earlier parts of the feed. Records with a null key, a null sequence number or
    an unknown operation have no effect. An empty feed gives an empty result.
    Copies of a record change nothing.
    """
    return _live(_retained(_feed(changes, key, seq, op, base, state), key, seq, hot_rows), key, seq)


def current_state(changes: DataFrame, key: str, seq: str, op: str, payload: list[str], base: DataFrame | None = None, hot_rows: int = HOT_ROWS, state: DataFrame | None = None) -> DataFrame:
    """(key, seq, *payload): live keys with the values of the record that determines them.

    Copies of one record may lack values: of each sequence number the copy with
    most values wins, ties by the largest values. ``base`` and ``state`` have the
    same columns, ``state`` also op.
    """
    rows = changes.select(key, seq, *payload)
    for more in (base, state):
        if more is not None:
            rows = rows.unionByName(more.select(key, seq, *payload))
    live = effective_lsn(changes, key, seq, op, base, hot_rows, state)
    best = (
        rows.join(live, [key, seq])
        .groupBy(key, seq)
        .agg(F.max(F.struct(_filled(payload).alias("_filled"), *payload)).alias("_best"))
    )
    return best.select(key, seq, *[F.col(f"_best.{c}") for c in payload])


def merged_state(changes: DataFrame, key: str, seq: str, op: str, payload: list[str], state: DataFrame | None = None, hot_rows: int = HOT_ROWS) -> DataFrame:
    """(key, seq, op, *payload): all that has to be kept of a feed, tombstones included.

    A valid ``state`` for the next part, in whatever order the parts come and
    however often: merged over the parts of a feed it is what the whole feed
    gives at once. ``live_state`` reads the live keys off it. A key that was
    deleted keeps its last delete as a row, so that an older insert that comes
    late doesn't bring it back; see ``_retained`` for the rest.
    """
    rows = changes.select(key, seq, operation(F.col(op)).alias("op"), *payload)
    if state is not None:
        rows = rows.unionByName(state.select(key, seq, "op", *payload))
    keep = _retained(_feed(changes, key, seq, op, None, state), key, seq, hot_rows)
    best = rows.join(keep, [key, seq, "op"]).groupBy(key, seq, "op").agg(F.max(F.struct(_filled(payload).alias("_filled"), *payload)).alias("_best"))
    return best.select(key, seq, "op", *[F.col(f"_best.{c}") for c in payload])


def live_state(state: DataFrame, key: str, seq: str, payload: list[str]) -> DataFrame:
    """(key, seq, *payload): the live keys of a merged state."""
    if not payload:
        return _live(state, key, seq)
    return state.where(F.col("op") != "D").select(key, seq, *payload).join(_live(state, key, seq), [key, seq])


def latest_state(changes: DataFrame, key: str, seq: str, op: str, payload: list[str], state: DataFrame | None = None) -> DataFrame:
    """(key, seq, deleted, *payload): last writer wins, tombstones retained.

    One maximum of struct(sequence, operation, payload) per key. The result is
    itself a valid ``state`` for the next part of the feed, in whatever order
    the parts come: a tombstone stays as a row, so an older change that arrives
    late can't bring its key back.
    """
    rows = changes.select(key, seq, (operation(F.col(op)) == "D").alias("deleted"), *payload).where(F.col(key).isNotNull() & F.col(seq).isNotNull() & F.col("deleted").isNotNull())
    if state is not None:
        rows = rows.unionByName(state.select(key, seq, "deleted", *payload))
    best = rows.groupBy(key).agg(F.max(F.struct(seq, "deleted", *payload)).alias("_best"))
    return best.select(key, *[F.col(f"_best.{c}") for c in (seq, "deleted", *payload)])


def terminal_state(changes: DataFrame, key: str, seq: str, op: str, payload: list[str], checkpoint_seq: int | None = None) -> DataFrame:
    """(key, seq, deleted, *payload): a delete is final, else the last insert or update wins.

    The law of a log whose ids are never reused. ``checkpoint_seq`` leaves out
    records before it.
    """
    rows = changes.select(key, seq, operation(F.col(op)).alias("_op"), *payload).where(F.col("_op").isin("I", "U", "D") & F.col(key).isNotNull())
    if checkpoint_seq is not None:
        rows = rows.where(F.col(seq) >= checkpoint_seq)
    best = rows.groupBy(key).agg(
        F.max(F.when(F.col("_op") != "D", F.struct(seq, *payload))).alias("_best"), F.max(F.col("_op") == "D").alias("deleted"), F.max(seq).alias("_last")
    )
    return best.select(key, F.when(F.col("deleted"), F.col("_last")).otherwise(F.col(f"_best.{seq}")).alias(seq), "deleted", *[F.when(~F.col("deleted"), F.col(f"_best.{c}")).alias(c) for c in payload])
