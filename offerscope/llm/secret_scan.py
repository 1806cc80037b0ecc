"""Secret scans with corpus-wide ownership frequency, in DataFrame functions only.

1. Every text is scanned once, by kind, leftmost and non-overlapping.  Three base kinds
   (``assign``, ``access``, ``hex``) are always reported.  Two wider kinds (``vendor``,
   ``loose``) are candidates only.
2. Each candidate's value is hashed, and the hashes are aggregated over the whole corpus
   by distinct repositories and distinct owners.
3. A value held by ``example_owners`` owners or more is a widely copied example; the number of
   repositories is reported with each span, but one owner's copies, in however many repositories,
   do not make a secret public.  Of the rest, values that look generated (digits and letters, enough different characters)
   are live-looking.  Wider candidates become spans only if they are live-looking.

Positions are code points, end exclusive: the text between matches comes from ``split``
with the same pattern, so the start of a match is the length of all that precedes it.
Only matches are shuffled, never texts.  A value that occurs in a third of all rows is
counted by partial sums and met by a join that adaptive execution can split.

Defined results: a null or empty text has no spans; a null owner or repository counts as
one of its own; repeated rows are scanned one by one; an empty table gives an empty result; other
columns, whatever their names, are ignored unless they are kept.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from offerscope.session import stage

# The kinds in the order in which they are listed, their patterns, the group
# that holds the value, and the least length of that group.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{16,}"
VENDOR = r"\b(?:gh[pousr]_[A-Za-z0-9]{20,}|xox[abprs]-[A-Za-z0-9-]{20,}|sk_live_[A-Za-z0-9]{16,}|AIza[A-Za-z0-9_-]{30,})"
LOOSE = r"""(?i:pwd|auth|bearer|credential|private_?key|access_?key|client_?id)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]{8,})"""
BASE = ("assign", "access", "hex")
KINDS = {
    "assign": (ASSIGN, 1, 12),
    "access": (ACCESS, 0, 18),
    "hex": (HEX, 0, 16),
    "vendor": (VENDOR, 0, 20),
    "loose": (LOOSE, 1, 8),
}


def _matches(text: Column, kind: str) -> Column:
    """All matches of a kind in order, each with the length of the gap before it."""
    pattern, group, _ = KINDS[kind]
    p = F.lit(pattern)
    found = F.transform(
        F.arrays_zip(
            F.split(text, pattern, -1).alias("gap"),
            F.regexp_extract_all(text, p, F.lit(0)).alias("whole"),
            F.regexp_extract_all(text, p, F.lit(group)).alias("value"),
        ),
        lambda m, i: F.struct(
            F.lit(kind).alias("kind"),
            i.alias("i"),
            F.char_length(m["gap"]).alias("gap"),
            F.char_length(m["whole"]).alias("length"),
            m["value"].alias("value"),
        ),
    )
    # the last gap has no match after it
    found = F.filter(found, lambda m: m["value"].isNotNull())
    return F.when(text.rlike(pattern), found)


def _none_if_no_match(text: Column) -> Column:
    per_kind = [F.coalesce(_matches(text, kind), F.array().cast(MATCHES)) for kind in KINDS]
    return reduce(lambda a, b: F.concat(a, b), per_kind)


MATCHES = "array<struct<kind:string,i:int,gap:int,length:int,value:string>>"


def scan(docs: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """``keep`` columns, a row id and the raw matches of every row, staged."""
    rows = docs.select(
        *keep,
        F.monotonically_increasing_id().alias("_row"),
        _none_if_no_match(F.coalesce(F.col(text), F.lit(""))).alias("_matches"),
    )
    return stage(rows, "secret-matches")


def candidates(scanned: DataFrame, owner: str, repository: list[str]) -> DataFrame:
    """One row per match that is long enough: row id, kind, start, end, value hash, owner, repository."""
    each = scanned.select(
        "_row",
        F.coalesce(F.col(owner), F.lit("\0")).alias("_owner"),
        F.concat_ws("\1", *[F.coalesce(F.col(c), F.lit("\0")) for c in repository]).alias("_repository"),
        F.explode("_matches").alias("m"),
    ).select("_row", "_owner", "_repository", "m.*")
    so_far = Window.partitionBy("_row", "kind").orderBy("i")
    placed = each.withColumn("end", F.sum(F.col("gap") + F.col("length")).over(so_far))
    long_enough = reduce(
        lambda a, b: a | b,
        [
            (F.col("kind") == kind) & (F.char_length("value") >= least)
            for kind, (_, _, least) in KINDS.items()
        ],
    )
    return placed.filter(long_enough).select(
        "_row",
        "kind",
        (F.col("end") - F.col("length")).alias("start"),
        "end",
        F.sha2(F.col("value"), 256).alias("value_hash"),
        generated(F.col("value")).alias("generated"),
        "_owner",
        "_repository",
    )


def generated(value: Column) -> Column:
    """Looks random: letters and digits, and at least eight different characters."""
    return (
        value.rlike("[0-9]")
        & value.rlike("[A-Za-z]")
        & (F.size(F.array_distinct(F.split(value, ""))) >= 8)
    )


def ownership(found: DataFrame) -> DataFrame:
    """Distinct repositories and owners of every value hash."""
    per_repository = found.groupBy("value_hash", "_owner", "_repository").agg(F.count(F.lit(1)).alias("n"))
    per_owner = per_repository.groupBy("value_hash", "_owner").agg(
        F.count(F.lit(1)).alias("repositories"), F.sum("n").alias("n")
    )
    return per_owner.groupBy("value_hash").agg(
        F.count(F.lit(1)).alias("n_owners"),
        F.sum("repositories").alias("n_repositories"),
        F.sum("n").alias("n_uses"),
    )


def classify(found: DataFrame, example_owners: int) -> DataFrame:
    """The spans to report, each with its ownership and whether it is live-looking."""
    judged = found.join(ownership(found), "value_hash").withColumn(
        "live", F.col("generated") & (F.col("n_owners") < example_owners)
    )
    return judged.filter(F.col("kind").isin(*BASE) | F.col("live"))


def _joined(spans: Column) -> Column:
    return F.array_join(
        F.transform(
            spans,
            lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string")),
        ),
        ",",
    )


def secret_spans(
    docs: DataFrame,
    keep: list[str],
    text: str = "text",
    owner: str = "source",
    repository: tuple[str, ...] = ("source", "lang"),
    example_owners: int = 3,
) -> DataFrame:
    """``keep`` columns of every row and ``spans``: array of kind, start, end, value_hash,
    n_owners, n_repositories, live; by start, then kind as listed."""
    extra = [c for c in dict.fromkeys((owner, *repository)) if c not in keep]
    scanned = scan(docs, text, [*keep, *extra])
    judged = classify(candidates(scanned, owner, list(repository)), example_owners)
    rank = F.element_at(F.create_map(*[F.lit(x) for i, k in enumerate(KINDS) for x in (k, i)]), F.col("kind"))
    spans = judged.groupBy("_row").agg(
        F.array_sort(
            F.collect_list(
                F.struct("start", rank.alias("rank"), "end", "kind", "value_hash", "n_owners", "n_repositories", "live")
            )
        ).alias("spans")
    )
    return scanned.select("_row", *keep).join(spans, "_row", "left").select(
        *keep, F.coalesce(F.col("spans"), F.array().cast(spans.schema["spans"].dataType)).alias("spans")
    )


def digest(found: DataFrame) -> DataFrame:
    """Counts per base kind, the checksum of the base spans, all spans as text, and ``spread``: how many
    owners and repositories hold each span's value, as owners:repositories in the spans' order."""
    spans = F.col("spans")
    base = F.filter(spans, lambda s: s["kind"].isin(*BASE))

    def count(kind: str) -> Column:
        return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")

    return found.select(
        *[c for c in found.columns if c != "spans"],
        *[count(kind).alias(f"n_{kind}") for kind in BASE],
        F.sha2(_joined(base), 256).alias("base_sha256"),
        _joined(spans).alias("spans"),
        F.array_join(
            F.transform(
                spans, lambda s: F.concat_ws(":", s["n_owners"].cast("string"), s["n_repositories"].cast("string"))
            ),
            ",",
        ).alias("spread"),
        F.size(F.filter(spans, lambda s: s["live"])).cast("long").alias("n_live"),
        F.size(F.filter(spans, lambda s: ~s["live"])).cast("long").alias("n_examples"),
    )


def redacted(text: Column, spans: Column, mark: str) -> Column:
    """``text`` with every span, overlapping ones as one, replaced by ``mark``."""
    start = F.lit(0)
    state = F.aggregate(
        spans,
        F.struct(F.array().cast("array<string>").alias("parts"), start.alias("at")),
        lambda s, x: F.struct(
            F.when(
                x["start"].cast("int") >= s["at"],
                F.array_append(
                    s["parts"], F.substring(text, s["at"] + 1, x["start"].cast("int") - s["at"])
                ),
            )
            .otherwise(s["parts"])
            .alias("parts"),
            F.greatest(s["at"], x["end"].cast("int")).alias("at"),
        ),
    )
    rest = F.substring(text, state["at"] + 1, F.char_length(text))
    return F.when(F.size(spans) == 0, text).otherwise(
        F.array_join(F.array_append(state["parts"], rest), mark)
    )
