"""Similar products: an exact top-k set-similarity join.

The score of two products depends only on their *feature*: the tag set, the leaf
category and the brand. So the join runs over distinct features. Each feature
carries a short list of its products that is long enough for every possible
exclusion of one page, and every product finally picks its own k from the list
of its feature. However many copies a feature has, it is joined once.

Features are joined in descending score bands. A feature whose list can serve
all its products leaves the search, since lower bands cannot improve it. Within
a band, pairs come from an equi-join on rare-first tag prefixes, with a separate
bound for each combination of equal leaf and equal brand. Where very many features have a prefix tag, pairs
have to share a second tag, or be small enough for one. Pairs that share no
tag have one of four known scores; for them short lists per leaf and brand are
enough, and no pairs are formed.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import ROUND_CEILING, Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skuloom import fixed_values as fv
from skuloom.functions import similarity as sim
from skuloom.schemas import ALTERNATIVE
from skuloom.session import materialize

# Half a unit of the fourth place: how far rounding can lift a score.
_ROUNDING = 0.00005
_STEP = 0.0001
# Scores are searched from the top; these are only the intermediate stops.
_STOPS = (0.7, 0.55)
# Index rows of one join key that a single task compares with; a tag that more features have in a
# lane is crowded and needs a second shared tag.
_CHUNK = 2_000
# sizes of tag sets that can do with one shared tag, at most; else such sets are not split by size
_SOLO_SIZES = 16
# chunks of the index for one part of the probes
_PROBE_SHARE = 4
# where a probe and an index row meet
_KEY = ["lane", "lane_leaf", "lane_brand", "tag", "tag2", "sizes"]
_MEETING = [*_KEY, "chunk", "part"]
_CANDIDATE = ["fid", "score", "shared", "item.place", "item.sku", "item.product_url", "item.product_name"]

# 64-bit sketch of a tag set; sets differ in at least as many tags as their
# sketches differ in bits.
_BITMAP = (
    "aggregate(tags, 0L, (bits, tag) -> bits | shiftleft(1L, cast(pmod(xxhash64(tag), 64) as int)))"
)

_NO_TAG_LEVELS = (
    # score of a pair without a shared tag, and what such a pair has in common
    (0.35, ("leaf", "brand")),
    (0.25, ("leaf",)),
    (0.10, ("brand",)),
    (0.0, ()),
)


@dataclass(frozen=True)
class _Lane:
    """Pairs with the same leaf and/or brand, or neither."""

    number: int
    leaf: bool
    brand: bool

    def bound(self, low: float) -> float:
        """Least Jaccard similarity that can reach ``low`` in this lane."""
        bonus = fv.LEAF_WEIGHT * self.leaf + fv.BRAND_WEIGHT * self.brand
        return max(0.0, (low - _ROUNDING - bonus) / fv.TAG_WEIGHT)


_LANES = (_Lane(1, True, True), _Lane(2, True, False), _Lane(3, False, True), _Lane(4, False, False))


def _feature_id(tags: Column, leaf: Column, brand: Column) -> Column:
    return F.unhex(F.md5(F.to_json(F.struct(tags, leaf, brand)).cast("binary")))


def _with_feature(products: DataFrame) -> DataFrame:
    """Add ``fid``, ``tags``, ``leaf``, ``brand_key``; ``fid`` is null without tags."""
    keyed = products.withColumns(
        {
            "tags": sim.tag_set(F.col("normalized_tags")),
            "leaf": sim.leaf_category(F.col("category_hierarchy")),
            "brand_key": sim.brand_key(F.col("brand")),
        }
    )
    return keyed.withColumn(
        "fid",
        F.when(F.size("tags") > 0, _feature_id(F.col("tags"), F.col("leaf"), F.col("brand_key"))),
    )


def _capped(rows: DataFrame, group: list[str], order: list[Column], per_url: int, total: int) -> DataFrame:
    """First ``per_url`` rows of every page, then first ``total`` rows, per group.

    Both ranks are limited in the map tasks before their shuffle.
    """
    by_url = Window.partitionBy(*group, "product_url").orderBy(*order)
    overall = Window.partitionBy(*group).orderBy(*order)
    return (
        rows.withColumn("__rank", F.row_number().over(by_url))
        .filter(F.col("__rank") <= per_url)
        .withColumn("__rank", F.row_number().over(overall))
        .filter(F.col("__rank") <= total)
        .drop("__rank")
    )


def _item() -> Column:
    # A missing SKU is ordered by the text "None".
    return F.struct(
        F.coalesce("sku", F.lit("None")).alias("place"), "sku", "product_url", "product_name"
    )


class _Search:
    """One top-k search. ``k`` alternatives per product, scores >= ``min_score``."""

    def __init__(self, products: DataFrame, k: int, min_score: float):
        self.k = k
        # scores have four places
        self.min_score = float(
            Decimal(str(min_score)).quantize(Decimal("0.0001"), rounding=ROUND_CEILING)
        )
        # join keys differ a lot in work: several tasks per core
        spark = products.sparkSession
        self.tasks = max(
            int(spark.conf.get("spark.sql.shuffle.partitions")),
            4 * spark.sparkContext.defaultParallelism,
        )
        self.per_url = k + 1
        self.total = 2 * k + 2
        self.base = _with_feature(products).filter(F.col("fid").isNotNull()).select(
            "fid", "tags", "leaf", "brand_key", "sku", "product_url", "product_name",
            _item()["place"].alias("place"),
        )
        self.features = materialize(self._features(), "features")

    def _features(self) -> DataFrame:
        """Distinct features with ranked tags and their first products."""
        listed = (
            _capped(self.base, ["fid"], [F.col("place")], self.per_url, self.total)
            .groupBy("fid")
            .agg(
                F.any_value("tags").alias("tags"),
                F.any_value("leaf").alias("leaf"),
                F.any_value("brand_key").alias("brand_key"),
                F.sort_array(F.collect_list(_item())).alias("items"),
            )
        )
        listed = materialize(listed, "feature-items")
        tags = listed.select("fid", F.explode("tags").alias("tag"))
        frequency = tags.groupBy("tag").agg(F.count("*").alias("n"))
        ranked = (
            tags.join(frequency, "tag")
            .groupBy("fid")
            .agg(F.sort_array(F.collect_list(F.struct("n", "tag"))).alias("ranked"))
            .select("fid", F.col("ranked.tag").alias("tags"))
            .withColumn("bits", F.expr(_BITMAP))
        )
        return listed.drop("tags").join(ranked, "fid")

    # -- candidates with shared tags ------------------------------------------

    def _signatures(self, features: DataFrame, low: float) -> DataFrame:
        """One row per lane and prefix tag of a feature.

        ``other_leaf`` and ``other_brand`` are what the partner must not have.
        """
        size = F.size("tags")
        own_leaf = F.nullif(F.col("leaf"), F.lit(""))
        parts = []
        for lane in _LANES:
            bound = lane.bound(low)
            if bound > 1.0:
                continue
            needed = F.greatest(F.lit(1), F.ceil(F.lit(bound) * size - F.lit(1e-9)).cast("int"))
            prefix = F.slice("tags", F.lit(1), size - needed + 1)
            leaf = F.col("leaf") if lane.leaf else F.lit("")
            brand = F.col("brand_key") if lane.brand else F.lit("")
            keys = F.transform(
                prefix,
                lambda tag, i: F.struct(  # evaluated at once, inside this turn of the loop
                    F.lit(lane.number).alias("lane"),
                    leaf.alias("lane_leaf"),
                    brand.alias("lane_brand"),
                    tag.alias("tag"),
                    (i + 1).alias("pos"),
                    # twice the shared tags a pair needs, per tag of both sets
                    F.lit(2 * bound / (1 + bound)).alias("ratio"),
                    needed.alias("needed"),
                    # tags of both sets that a pair with one shared tag may have
                    F.lit(int(1 / bound + 1e-6) if bound > 1 / _SOLO_SIZES else None).cast("int").alias("widest"),
                    (F.lit(None).cast("string") if lane.leaf else own_leaf).alias("other_leaf"),
                    (F.lit(None).cast("string") if lane.brand else F.col("brand_key")).alias(
                        "other_brand"
                    ),
                ),
            )
            usable = F.lit(True)
            if lane.leaf:
                usable = usable & (F.col("leaf") != "")
            if lane.brand:
                usable = usable & F.col("brand_key").isNotNull()
            parts.append(F.when(usable, keys).otherwise(F.slice(keys, 1, 0)))
        keyed = features.withColumn("key", F.explode(F.concat(*parts)))
        return keyed.select("*", "key.*", size.alias("n")).drop("key")

    def _keyed(self, features: DataFrame, low: float, crowded: DataFrame, probing: bool) -> DataFrame:
        """Signatures with a join key: one tag, or, where that is crowded, more than one tag.

        Two features whose first shared tag is crowded meet by their first two shared tags: with
        ``needed`` shared tags, the second of them is among the first ``size - needed + 2``. If
        they share that tag alone (``solo``), both sets must be small for their similarity, and they meet by
        their sizes. So features that share a crowded tag and nothing else do not meet, unless that
        one tag is enough.
        """
        rows = self._signatures(features, low).join(crowded, ["lane", "lane_leaf", "lane_brand", "tag"], "left")

        def key(tag2: Column, last: Column, held: int, solo: bool, sizes: Column) -> Column:
            return F.struct(
                tag2.alias("tag2"), last.cast("int").alias("last"), F.lit(held).alias("held"),
                F.lit(solo).alias("solo"), sizes.alias("sizes"),
            )

        none, pos = F.lit(""), F.col("pos")
        reach = F.greatest(F.col("n") - F.col("needed") + 2 - pos, F.lit(0))
        pairs = F.transform(
            F.slice("tags", pos + 1, reach), lambda tag, i: key(tag, pos + i + 1, 2, False, none)
        )
        most = F.col("widest") - F.col("n") + 1
        both = lambda m: (F.col("n"), m) if probing else (m, F.col("n"))
        solo = (
            F.when(F.col("widest").isNull(), F.array(key(none, pos, 1, True, none)))
            .when(
                most >= 1,
                F.transform(
                    F.sequence(F.lit(1), F.greatest(most, F.lit(1))),
                    lambda m: key(none, pos, 1, True, F.concat_ws("x", *[c.cast("string") for c in both(m)])),
                ),
            )
            .otherwise(F.slice(F.array(key(none, pos, 1, True, none)), 1, 0))
        )
        one = F.array(key(none, pos, 1, False, none))
        keys = F.when(F.col("crowded"), F.concat(pairs, solo)).otherwise(one)
        return rows.withColumn("key", F.explode(keys)).select("*", "key.*").drop("key", "crowded", "needed", "widest")

    def _tag_pairs(self, probes: DataFrame, low: float) -> DataFrame:
        """Probes and index rows that meet at a join key."""
        crowded = (
            self._signatures(self.features.drop("items"), low)
            .groupBy("lane", "lane_leaf", "lane_brand", "tag")
            .agg(F.count("*").alias("n"))
            .filter(F.col("n") > _CHUNK)
            .select("lane", "lane_leaf", "lane_brand", "tag", F.lit(True).alias("crowded"))
        )
        crowded = materialize(crowded, "crowded-tags")
        index = self._keyed(self.features, low, crowded, False).select(
            *_KEY, F.col("fid").alias("g_fid"), F.col("tags").alias("g_tags"),
            F.col("leaf").alias("g_leaf"), F.col("brand_key").alias("g_brand"),
            F.col("pos").alias("g_pos"), F.col("last").alias("g_last"), F.col("bits").alias("g_bits"), F.col("n").alias("g_n"), "items",
        )
        # Hot keys: a grid of index chunks and probe parts.
        hot = (
            self._keyed(self.features.drop("items"), low, crowded, False)
            .groupBy(*_KEY)
            .agg(F.ceil(F.count("*") / F.lit(_CHUNK)).cast("int").alias("chunks"))
            .filter(F.col("chunks") > 1)
        )
        one = F.lit(1)
        # probes of a hot key are cut as well, into fewer parts, as index rows are wider
        parts = F.ceil(F.coalesce("chunks", one) / _PROBE_SHARE).cast("int")
        index = (
            index.join(hot, _KEY, "left")
            .withColumn("chunk", F.pmod(F.hash("g_fid"), F.coalesce("chunks", one)))
            .withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1)))
            .drop("chunks")
        )
        sought = (
            self._keyed(probes.drop("items"), low, crowded, True)
            .join(hot, _KEY, "left")
            .withColumn("part", F.pmod(F.hash("fid", F.lit("part")), parts))
            .withColumn(
                "chunk", F.explode(F.sequence(F.lit(0), F.coalesce("chunks", one) - 1))
            )
            .drop("chunks")
        )
        # The work of a pair join is not in proportion to its bytes: keep all tasks.
        return sought.repartition(self.tasks, *_MEETING).join(
            index.repartition(self.tasks, *_MEETING), _MEETING
        )

    def _tag_candidates(self, probes: DataFrame, low: float, high: float) -> DataFrame:
        """Candidates of the probes that share a tag and score in [low, high)."""
        pairs = self._tag_pairs(probes, low)
        # The join condition is evaluated for every pair of a key, so it is kept
        # small enough for the JIT compiler: upper bounds of the shared tags from
        # the sketches and from the place of the first shared tag, then the lane.
        tags_of_both = F.col("n") + F.col("g_n")
        twice_needed = F.col("ratio") * tags_of_both - F.lit(1e-6)
        differing = F.bit_count(F.col("bits").bitwiseXOR(F.col("g_bits")))
        rest = F.least(F.col("n") - F.col("last"), F.col("g_n") - F.col("g_last"))
        between = lambda tags, pos, last: F.slice(tags, F.col(pos) + 1, F.greatest(F.col(last) - F.col(pos) - 1, F.lit(0)))
        pairs = pairs.filter(
            (tags_of_both - differing >= twice_needed)
            & (2 * (rest + F.col("held")) >= twice_needed)
            & F.coalesce(F.col("other_leaf") != F.col("g_leaf"), F.lit(True))
            & F.coalesce(F.col("other_brand") != F.col("g_brand"), F.lit(True))
            & (F.col("fid") != F.col("g_fid"))
            & ~F.arrays_overlap(
                F.slice("tags", F.lit(1), F.col("pos") - 1),
                F.slice("g_tags", F.lit(1), F.col("g_pos") - 1),
            )
            & ~F.arrays_overlap(between("tags", "pos", "last"), between("g_tags", "g_pos", "g_last"))
        )
        common = F.size("shared")
        raw = sim.raw_score(
            common,
            tags_of_both - common,
            F.col("lane").isin([x.number for x in _LANES if x.leaf]),
            F.col("lane").isin([x.number for x in _LANES if x.brand]),
        )
        in_band = sim.reaches(F.col("raw"), low) & ~sim.reaches(F.col("raw"), high) & (~F.col("solo") | (common == 1))
        # Exploding nothing drops a pair after the join, without widening the
        # join condition as a filter would.
        found = (
            pairs.withColumn("shared", F.array_intersect("tags", "g_tags"))
            .withColumn("raw", raw)
            .select(*_MEETING, "fid", "raw", "shared", F.explode(F.when(in_band, F.col("items"))).alias("item"))
            .withColumn("score", sim.rounded(F.col("raw")))
            .select(*_MEETING, *_CANDIDATE)
        )
        # What the list of a probe has no place for is dropped where it was found: the pairs of a join
        # key are in one task, and the best of all are among the best of each key.
        return self._best(found, [*_MEETING, "fid"]).drop(*_MEETING)

    def _own_candidates(self, probes: DataFrame, low: float, high: float) -> DataFrame:
        """Other products of the same feature."""
        own = sim.raw_score(
            F.lit(1.0), F.lit(1.0), F.col("leaf") != "", F.col("brand_key").isNotNull()
        )
        return (
            probes.filter(sim.reaches(own, low) & ~sim.reaches(own, high))
            .select(
                "fid",
                sim.rounded(own).alias("score"),
                F.col("tags").alias("shared"),
                F.explode("items").alias("item"),
            )
            .transform(_candidate_rows)
        )

    # -- candidates without a shared tag --------------------------------------

    def _level_candidates(
        self, probes: DataFrame, lists: DataFrame, level: float, key: tuple[str, ...]
    ) -> DataFrame:
        """Candidates that score exactly ``level``, sharing no tag.

        The lists hold every page with a better-scoring product (else the probe
        would have left), so on all other pages of the block each product scores
        exactly ``level``. On the pages listed, products are checked one by one.
        """
        columns = {"leaf": "leaf", "brand": "brand_key"}
        names = [columns[k] for k in key]
        present = F.lit(True)
        if "leaf" in key:
            present = present & (F.col("leaf") != "")
        if "brand" in key:
            present = present & F.col("brand_key").isNotNull()
        seen = lists.select("fid", F.array_distinct("list.product_url").alias("seen"))
        seekers = (
            probes.drop("items")
            .filter(present)
            .join(seen, "fid", "left")
            .withColumn("seen", F.coalesce("seen", F.array().cast("array<string>")))
        )
        no_tags = F.array().cast("array<string>")

        # pages not seen: the first products of the block, as one short list
        most_seen = (self.total - 1) * self.per_url
        group = names or ["whole"]
        block = (
            _capped(
                self.base.filter(present).withColumn("whole", F.lit(0)),
                group,
                [F.col("place")],
                self.per_url,
                most_seen + self.total,
            )
            .groupBy(*group)
            .agg(F.sort_array(F.collect_list(_item())).alias("block"))
        )
        if names:
            with_block = seekers.join(block, names)
        else:
            # a single row of at most ``most_seen + total`` products
            with_block = seekers.withColumn("whole", F.lit(0)).join(F.broadcast(block), "whole")
        elsewhere = (
            with_block.withColumn(
                "block",
                F.filter(
                    "block",
                    lambda item: ~F.exists("seen", lambda u: u.eqNullSafe(item["product_url"])),
                ),
            )
            .select(
                "fid",
                F.lit(level).alias("score"),
                no_tags.alias("shared"),
                F.explode("block").alias("item"),
            )
            .transform(_candidate_rows)
        )

        # pages seen: their products with the same leaf and brand, scored
        by_url = Window.partitionBy("fid", "product_url").orderBy("place")
        on_page = (
            self.base.filter(present)
            .withColumn("__rank", F.row_number().over(by_url))
            .filter(F.col("__rank") <= self.per_url)
            .select(
                F.col("fid").alias("g_fid"), F.col("tags").alias("g_tags"),
                F.col("leaf").alias("g_leaf"), F.col("brand_key").alias("g_brand"),
                F.col("product_url").alias("g_url"), _item().alias("item"),
            )
        )
        visits = seekers.withColumn("page", F.explode("seen"))
        match = F.col("page").eqNullSafe(F.col("g_url"))
        for name, other in (("leaf", "g_leaf"), ("brand_key", "g_brand")):
            if name in names:
                match = match & (F.col(name) == F.col(other))
        leaf = sim.same_leaf(F.col("leaf"), F.col("g_leaf"))
        brand = sim.same_brand(F.col("brand_key"), F.col("g_brand"))
        common = F.size(F.array_intersect("tags", "g_tags"))
        raw = sim.raw_score(common, F.size("tags") + F.size("g_tags") - common, leaf, brand)
        on_seen = (
            visits.join(on_page, match)
            .filter(~sim.reaches(raw, level + _STEP))
            .select("fid", F.lit(level).alias("score"), no_tags.alias("shared"), "item")
            .transform(_candidate_rows)
        )
        return elsewhere.unionByName(on_seen)

    # -- bands -----------------------------------------------------------------

    def _best(self, candidates: DataFrame, group: list[str]) -> DataFrame:
        """Candidates that can be in the list of a feature, by those of their group."""
        return _capped(candidates, group, [F.col("score").desc(), F.col("place")], self.per_url, self.total)

    def _lists(self, candidates: DataFrame) -> DataFrame:
        """Best candidates per feature, and whether they serve all its products."""
        lists = (
            self._best(candidates, ["fid"])
            .groupBy("fid")
            .agg(
                F.sort_array(
                    F.collect_list(
                        F.struct(
                            (-F.col("score")).alias("rank"), "place", "sku", "product_url",
                            "product_name", "score", "shared",
                        )
                    )
                ).alias("list")
            )
        )
        most_on_a_page = F.array_max(
            F.transform(
                "list",
                lambda x: F.size(
                    F.filter("list", lambda y: y["product_url"].eqNullSafe(x["product_url"]))
                ),
            )
        )
        return lists.withColumn("full", F.size("list") - most_on_a_page - 1 >= self.k)

    def _bands(self) -> Iterator[tuple[float, float, tuple[str, ...] | None]]:
        """(low, high, level key) from the top down to ``min_score``."""
        high = 1.0 + _STEP
        stops = [s for s in _STOPS if s > self.min_score]
        for level, key in _NO_TAG_LEVELS:
            if level < self.min_score:
                break
            for low in [*stops, level + _STEP]:
                low = round(low, 4)
                if low < high:
                    yield low, high, None
                    high = low
            yield level, high, key
            high = level
            stops = []
        for low in [*stops, self.min_score]:
            if low < high:
                yield low, high, None
                high = low

    def run(self) -> DataFrame:
        """``fid, list`` for every feature that has candidates."""
        probes, lists, finished = self.features, None, []
        for low, high, level_key in self._bands():
            if level_key is None:
                found = self._own_candidates(probes, low, high).unionByName(
                    self._tag_candidates(probes, low, high)
                )
            else:
                found = self._level_candidates(
                    probes, lists.filter(~F.col("full")), low, level_key
                )
            if lists is not None:
                kept = lists.filter(~F.col("full")).select("fid", F.explode("list").alias("item"))
                found = found.unionByName(
                    kept.select("fid", "item.score", "item.shared", "item").transform(_candidate_rows)
                )
            if level_key is None:
                # few rows of a feature are left: one shuffle serves both ranks and the grouping
                found = found.repartition("fid")
            lists = materialize(self._lists(found), "candidates")
            finished.append(lists.filter("full").select("fid", "list"))
            probes = probes.join(lists.filter("full"), "fid", "left_anti")
            if probes.isEmpty():
                break
        finished.append(lists.filter(~F.col("full")).select("fid", "list"))
        result = finished[0]
        for part in finished[1:]:
            result = result.unionByName(part)
        return result


def _candidate_rows(df: DataFrame) -> DataFrame:
    return df.select(*_CANDIDATE)


def similar_products(
    products: DataFrame,
    *,
    max_alternatives: int = fv.MAX_ALTERNATIVES,
    min_score: float = fv.MIN_SCORE,
) -> DataFrame:
    """Add ``alternative_products``: the best matches, by score then SKU.

    Needs ``sku`` (unique), ``product_name``, ``product_url``, ``brand``,
    ``category_hierarchy`` and ``normalized_tags``. Products without tags, and
    products nothing matches, get an empty array.
    """
    if max_alternatives < 1:
        raise ValueError("max_alternatives must be at least 1")
    if not 0 <= min_score <= 1:
        raise ValueError("min_score must be between 0 and 1")
    lists = _Search(products, max_alternatives, min_score).run()
    own_sku, own_url = F.col("sku"), F.col("product_url")
    chosen = F.slice(
        F.filter(
            "list", lambda x: sim.eligible(own_sku, own_url, x["sku"], x["product_url"])
        ),
        1,
        max_alternatives,
    )
    alternatives = F.transform(
        chosen,
        lambda x: F.struct(
            x["sku"].alias("sku"),
            x["product_name"].alias("product_name"),
            x["product_url"].alias("product_url"),
            x["score"].alias("score"),
            sim.reason(F.array_sort(x["shared"])).alias("reason"),
            F.lit(fv.ALTERNATIVE_SOURCE).alias("source"),
            F.lit(fv.ALTERNATIVE_METHOD).alias("method"),
        ),
    )
    empty = F.array().cast(f"array<{ALTERNATIVE}>")
    columns = [c for c in products.columns if c != "alternative_products"]
    placed = _with_feature(products)
    # products without tags match nothing; they stay out of the join, where they would all
    # meet in the task of the missing feature
    untagged = placed.filter(F.col("fid").isNull()).withColumn("alternative_products", empty)
    tagged = (
        placed.filter(F.col("fid").isNotNull())
        .join(lists, "fid", "left")
        .withColumn("alternative_products", F.coalesce(alternatives, empty))
    )
    return tagged.select(*columns, "alternative_products").unionByName(
        untagged.select(*columns, "alternative_products")
    )
