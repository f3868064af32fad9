"""A batch of documents against a catalogue, as if its rows came one after another.

A document is found by its place (workspace, kind, path, owners and creator); with another content it is revised, with
the same it stays. At a new place a row reuses a document that has the content at that moment (same workspace, owners and
creator, any kind), else it creates one. What a row finds depends on rows of the batch before it, but only through which
row creates each new place: from there on the place's later rows set its content. So the batch is solved by iteration over
that one number: all contents' time spans follow from it by joins and running aggregates, and from those which row of
each place finds its content nowhere. A row depends on earlier ones only, so what stands still is the solution.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmark.operators.running import before, key_of, width
from quillmark.session import cut

OWNERSHIP = ["workspace_id", "scope_type", "owner_user_id", "owner_department_id", "created_by_user_id"]
PLACE = ["source_type", "source_path", *OWNERSHIP]
CONTENT = ["content_hash", *OWNERSHIP]
ALWAYS = (1 << 62) - 1


def _known(existing: DataFrame, batch: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of the catalogue: the documents at the batch's places, and of all others the least with each of its contents."""
    e = existing.filter("source_path is not null").withColumn("_place", key_of(*PLACE))
    touched = e.join(batch.select("_place").distinct(), "_place", "left_semi").groupBy("_place").agg(F.min_by(F.struct(F.col("document_id").alias("id"), key_of(*CONTENT).alias("content"), F.col("current_revision").cast("long").alias("revision")), "document_id").alias("_old"))
    others = existing.withColumn("_content", key_of(*CONTENT)).join(batch.select("_content").distinct(), "_content", "left_semi")
    others = others.join(touched.select(F.col("_old.id").alias("document_id")), "document_id", "left_anti")
    still = others.groupBy("_content").agg(F.min(F.struct(F.lit(-ALWAYS).alias("end"), F.col("document_id").alias("id"), F.col("current_revision").cast("long").alias("revision"))).alias("_held"))
    return touched, still


def classify(existing: DataFrame, incoming: DataFrame, order: str = "document_id") -> DataFrame:
    """incoming (document_id, content_hash, PLACE) against existing (the same, current_revision), taken in the order of a
    long that no two rows share.

    Returns incoming with target_id, change and revision: `unchanged` where the place has the content, `updated` where it
    has another one, `reused` where another document has it (of these the one whose place the batch touches next the
    latest, then of the least id), else `created`, with the row's own document_id. A row without path has a place of its own.
    """
    own = incoming.withColumns({"_at": F.col(order).cast("long"), "_content": key_of(*CONTENT)})
    own = own.withColumn("_place", F.when(F.col("source_path").isNull(), F.concat(F.lit("row "), F.col("_at").cast("string"))).otherwise(key_of(*PLACE)))
    touched, still = _known(existing, own)
    rows = cut(own.select("_at", "document_id", "_place", "_content").join(touched, "_place", "left"))  # read several times
    span = width(rows, "_at")
    # the place's row before and after, and how often its content has changed up to here
    rows = before(rows, "_place", "_at", span, {"_last": (F.max, F.struct("_at", "_content"))})
    rows = before(rows.withColumn("_back", -F.col("_at")), "_place", "_back", span, {"_next": (F.min, "_at")})
    was = F.coalesce("_last._content", "_old.content")
    rows = rows.withColumn("_differs", F.coalesce(was != F.col("_content"), F.lit(False)).cast("long"))
    rows = before(rows, "_place", "_at", span, {"_changes": (F.sum, "_differs")})
    rows = cut(rows.withColumn("_changes", F.coalesce("_changes", F.lit(0)) + F.col("_differs")))
    old = rows.filter("_old is not null").groupBy("_place").agg(F.min(F.struct("_at", "_old")).alias("r")).select(F.col("r._old.content").alias("_content"), F.struct((-F.col("r._at")).alias("end"), F.col("r._old.id").alias("id"), F.col("r._old.revision").alias("revision")).alias("_held"))
    old = cut(old.union(still))
    first = F.min(F.struct("_at", "document_id", "_changes")).alias("_creates")
    creates = rows.filter("_old is null").groupBy("_place").agg(first)
    stood = None
    while True:
        state = cut(_seen(rows, old, creates, span))
        creates = state.filter(F.col("_old").isNull() & ~F.col("_found")).groupBy("_place").agg(first)
        stands = tuple(creates.agg(F.count("*"), F.sum(F.xxhash64("_place", "_creates._at").cast("decimal(38,0)"))).first())
        if stands == stood:
            break
        stood = stands
    found = state.select(
        "_at", _change().alias("change"),
        F.when(_there(), F.col("_id")).otherwise(F.col("_held.id")).alias("target_id"), F.when(_there(), F.col("_revision")).otherwise(F.col("_held.revision")).alias("revision"),
    )
    return own.join(found, "_at").select(*incoming.columns, "change", "target_id", "revision")


def _there() -> Column:
    """Whether the row's place has a document once the row is done."""
    return F.col("_old").isNotNull() | F.coalesce(F.col("_at") >= F.col("_creates._at"), F.lit(False))


def _change() -> Column:
    return F.when(~_there(), "reused").when(F.col("_old").isNull() & (F.col("_at") == F.col("_creates._at")), "created").when(F.col("_differs") == 1, "updated").otherwise("unchanged")


def _seen(rows: DataFrame, old: DataFrame, creates: DataFrame, span: int) -> DataFrame:
    """rows with the document of their place after them and its revision (_id, _revision), if creates is right, and the
    document that has their content just before (_held), and whether there is one (_found). The running least of the spans
    that began, the latest end first, is one that lasts if any does."""
    placed = rows.join(creates, "_place", "left").withColumns({"_id": F.coalesce("_old.id", "_creates.document_id"), "_revision": F.coalesce(F.col("_old.revision") + F.col("_changes"), 1 + F.col("_changes") - F.col("_creates._changes"))})
    held = F.when(_there(), F.struct((-F.coalesce("_next", F.lit(ALWAYS))).alias("end"), F.col("_id").alias("id"), F.col("_revision").alias("revision")))
    running = before(placed, "_content", "_at", span, {"_best": (F.min, held)})
    best = F.least("_best", "_first")
    return running.join(old.groupBy("_content").agg(F.min("_held").alias("_first")), "_content", "left").withColumns({"_held": best, "_found": F.coalesce(-best["end"] >= F.col("_at"), F.lit(False))}).drop("_best", "_first")


def reusable(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """The probe before anything is embedded: incoming with the document that already has the content, at the row's place
    or, if not there, anywhere in its ownership (the least id); null if none has."""
    own = incoming.withColumns({"_place": F.when(F.col("source_path").isNotNull(), key_of(*PLACE, "content_hash")), "_content": key_of(*CONTENT)})
    place = existing.filter("source_path is not null").groupBy(key_of(*PLACE, "content_hash").alias("_place")).agg(F.min("document_id").alias("_here"))
    content = existing.groupBy(key_of(*CONTENT).alias("_content")).agg(F.min("document_id").alias("_there"))
    return own.join(place, "_place", "left").join(content, "_content", "left").select(*incoming.columns, F.coalesce("_here", "_there").alias("reusable_id"))


def revisions(classified: DataFrame) -> DataFrame:
    """The rows to append to the revision log."""
    return classified.filter(F.col("change").isin("created", "updated")).select(F.col("target_id").alias("document_id"), F.col("revision").alias("revision_no"), "content_hash", F.col("change").alias("change_type"))


def latest(classified: DataFrame) -> DataFrame:
    """Of each document that the batch created or revised, the row that stays: its chunks replace all older ones."""
    rows = classified.filter(F.col("change").isin("created", "updated"))
    return rows.groupBy("target_id").agg(F.max_by(F.struct(*[c for c in rows.columns if c != "target_id"]), "revision").alias("r")).select("r.*", "target_id")


def upserted(existing: DataFrame, classified: DataFrame) -> DataFrame:
    """The catalogue after the batch: revised documents take the new values and are active again (no reason, no date of
    invalidation), their creator stays; new ones are active; columns that the batch lacks stay, or are null."""
    fresh = latest(classified).withColumn("document_id", F.col("target_id")).withColumns({"current_revision": F.col("revision"), "status": F.lit("active")})
    cleared = [c for c in ("invalid_reason", "invalidated_at") if c in existing.columns]
    own = [c for c in fresh.columns if c in existing.columns and c != "document_id"]
    new = fresh.select("document_id", F.lit(True).alias("_hit"), *[F.col(c).alias(f"_{c}") for c in own])
    both = existing.join(new, "document_id", "full_outer")
    pick = lambda c: F.coalesce(c, f"_{c}") if c == "created_by_user_id" else F.when(F.col("_hit"), F.col(f"_{c}")).otherwise(F.col(c))
    return both.select(*[c if c == "document_id" else pick(c).cast(existing.schema[c].dataType).alias(c) if c in own else F.when(F.col("_hit").isNull(), F.col(c)).alias(c) if c in cleared else F.col(c) for c in existing.columns])
