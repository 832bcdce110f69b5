"""Nearest neighbours at any distance.

First a ring: places meet in cells of about the spacing of the targets and the 26 around, and a
place is settled if what it found is no further than a cell, as everything beyond the ring is.
The others descend a tree of boxes.  A level of the tree has the cells of half the size of the
one above, each with the box of the targets in it; of the boxes that a place holds, and of
their parts two levels below, those stay that may be nearer than the furthest corner of the nearest
one.  A place keeps few boxes at any level, however far its neighbour is and however targets lie.

Every round is an equi-join on cells and an aggregation by place, written before the next.
Equal places are searched once, so no key has more rows than there are places.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .lineage import settle
from .ranks import met

AXES = "xyz"
SMALL = 50_000  # rows of a level of the tree that are broadcast, some MB
MATES = 16
STEP = 2  # levels that a round descends
LEVELS = 40


def _gap(pairs: list[tuple[Column, Column]]) -> Column:
    return F.sqrt(sum((d * d for d in (a - b for a, b in pairs)), F.lit(0.0)))


def spacing(spots: DataFrame) -> tuple[float, list[float], int]:
    """The size of a cell, the least corner and the number of levels above the cells, from
    targets that have different places.  The cell is what a target has to itself on average, halved
    until targets have few others in their cell, also where most of them stand close together."""
    s = spots.agg(F.count("*").alias("n"), *(f(a).alias(f"{m}{a}") for a in AXES for m, f in (("lo", F.min), ("hi", F.max)))).first()
    low, wide = [s[f"lo{a}"] for a in AXES], [s[f"hi{a}"] - s[f"lo{a}"] for a in AXES]
    spans = [w for w in wide if w > 0]
    if not spans:
        return 1.0, low, 0
    volume = 1.0
    for w in spans:
        volume *= w / max(spans)
    cell = max(spans) * (volume / s["n"]) ** (1 / len(spans))
    while max(spans) / cell < 2**LEVELS:
        held = spots.groupBy(*(F.floor((F.col(a) - x) / cell) for a, x in zip(AXES, low, strict=True))).agg(F.count("*").alias("c"))
        if held.agg(F.sum(F.col("c") * F.col("c")) / F.sum("c")).first()[0] <= MATES:
            break
        cell /= 2
    levels = 0
    while cell * 2**levels <= max(spans):
        levels += 1
    return cell, low, levels


def _index(cell: float, low: list[float]) -> dict[str, Column]:
    return {f"c{a}": F.floor((F.col(a) - x) / cell).cast("long") for a, x in zip(AXES, low, strict=True)}


_BOX = [f"{m}{a}" for a in AXES for m in ("lo", "hi")]
_CELL = [f"c{a}" for a in AXES]


def _tree(spots: DataFrame, cell: float, low: list[float], levels: int) -> list[DataFrame]:
    """The boxes of every level, from the whole (one a group) down to the cells."""
    box = [f(a).alias(f"{m}{a}") for a in AXES for m, f in (("lo", F.min), ("hi", F.max))]
    out = [settle(spots.withColumns(_index(cell, low)).groupBy("g", *_CELL).agg(*box))]
    for _ in range(levels):
        wider = [(F.min if b.startswith("lo") else F.max)(b).alias(b) for b in _BOX]
        out.append(out[-1].groupBy("g", *(F.shiftright(c, 1).alias(c) for c in _CELL)).agg(*wider))
    return out[::-1]


def _descend(state: DataFrame, spots: DataFrame, cell: float, low: list[float], levels: int, own: bool, want: bool) -> DataFrame:
    """(place, dist) for the places of state, (x, y, z, g, want, u): u is a distance that is known
    to be enough, or null."""
    place = [*AXES, "g", "want"]
    tree = _tree(spots, cell, low, levels)
    small = tree[-1].count() <= SMALL  # then every level above is, too
    ok = F.lit(True)
    if own:
        ok = ok & ~F.col("tg").eqNullSafe(F.col("g"))
    if want:
        ok = ok & F.col("tg").eqNullSafe(F.col("want"))
    roots = tree[0].select(F.col("g").alias("tg"), *_CELL).distinct()
    held = state.join(F.broadcast(roots), ok).groupBy(*place).agg(F.min("u").alias("u"), F.collect_list(F.struct("tg", *_CELL)).alias("cand"))  # a root for each group
    steps = [*range(levels, 0, -STEP), 0][::-1]
    for above, level in zip(steps, steps[1:]):
        boxes = tree[level]
        kids = boxes.select(F.col("g").alias("tg"), *(F.shiftright(c, level - above).alias(f"p{c}") for c in _CELL), *_CELL, *_BOX)
        kids = F.broadcast(kids) if small or boxes.count() <= SMALL else kids
        cand = held.select(*place, "u", F.explode("cand").alias("b")).select(*place, "u", "b.tg", *(F.col(f"b.{c}").alias(f"p{c}") for c in _CELL))
        found = met(cand, kids, ["tg", *(f"p{c}" for c in _CELL)])
        near = _gap([(F.greatest(F.lit(0.0), F.col(f"lo{a}") - F.col(a), F.col(a) - F.col(f"hi{a}")), F.lit(0.0)) for a in AXES])
        far = _gap([(F.greatest(F.abs(F.col(a) - F.col(f"lo{a}")), F.abs(F.col(a) - F.col(f"hi{a}"))), F.lit(0.0)) for a in AXES])
        agg = found.groupBy(*place).agg(F.least(F.min("u"), F.min(far)).alias("u"), F.collect_list(F.struct(near.alias("near"), "tg", *_CELL)).alias("cand"))
        kept = F.transform(F.filter("cand", lambda b: b["near"] <= F.col("u")), lambda b: F.struct(b["tg"].alias("tg"), *(b[c].alias(c) for c in _CELL)))
        held = settle(agg.select(*place, "u", kept.alias("cand")))
    cand = held.select(*place, F.explode("cand").alias("b")).select(*place, "b.*")
    ends = spots.withColumns(_index(cell, low)).select(F.col("g").alias("tg"), *_CELL, *(F.col(a).alias(f"t{a}") for a in AXES))
    return met(cand, ends, ["tg", *_CELL]).groupBy(*place).agg(F.min(_gap([(F.col(a), F.col(f"t{a}")) for a in AXES])).alias("dist"))


def _places(df: DataFrame, group: str | None) -> DataFrame:
    ok = df.filter(" and ".join(f"{a} is not null" for a in AXES))
    return ok.select(*(F.col(a).cast("double").alias(a) for a in AXES), (F.col(group) if group else F.lit(None).cast("int")).alias("g"))


def _back(points: DataFrame, found: DataFrame, key: str, group: str | None, also: list[str]) -> DataFrame:
    on = F.lit(True)
    for a in AXES:
        on = on & (F.col(a).cast("double") == F.col(f"_{a}"))
    if group:
        on = on & F.col(group).eqNullSafe(F.col("_g"))
    side = found.withColumnsRenamed({**{a: f"_{a}" for a in AXES}, "g": "_g"})
    return points.join(side, on, "left").select(key, *also, "dist")


def nearest(points: DataFrame, targets: DataFrame, key: str, apart: str | None = None, cell: float | None = None) -> DataFrame:
    """(key, dist): the distance from each point (key, x, y, z) to its nearest target (x, y, z), at any
    distance.  ``apart`` names a column of both; targets with the point's own value don't count.

    Null where there is no such target and for a point without coordinates; targets without are left out; repeated
    points have a row each.  ``cell``, by default from the targets, changes the work and no result."""
    spots = settle(_places(targets, apart).distinct())
    if spots.isEmpty():
        return points.select(key, F.lit(None).cast("double").alias("dist"))
    own, low, levels = spacing(spots)
    if cell is not None:
        levels = max(0, levels + int(-(-(own / cell) // 1)).bit_length())
        own = cell
    asked = settle(_places(points, apart).distinct().withColumn("want", F.lit(None).cast("int")))
    around = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.lit(c).alias("c")) for a in (-1, 0, 1) for b in (-1, 0, 1) for c in (-1, 0, 1)))
    seen = asked.withColumns(_index(own, low)).withColumn("o", F.explode(around)).withColumns({f"c{a}": F.col(f"c{a}") + F.col(f"o.{m}") for a, m in zip(AXES, "abc", strict=True)})
    near = spots.withColumns(_index(own, low)).select(F.col("g").alias("tg"), *_CELL, *(F.col(a).alias(f"t{a}") for a in AXES))
    pairs = seen.join(near, _CELL)
    if apart:
        pairs = pairs.filter(~F.col("tg").eqNullSafe(F.col("g")))
    ring = pairs.groupBy(*AXES, "g").agg(F.min(_gap([(F.col(a), F.col(f"t{a}")) for a in AXES])).alias("dist"))
    ring = settle(_left(asked.drop("want"), ring))
    done = ring.filter(F.col("dist") <= own).select(*AXES, "g", "dist")
    open_ = ring.filter(F.col("dist").isNull() | (F.col("dist") > own)).select(*AXES, "g", F.lit(None).cast("int").alias("want"), F.col("dist").alias("u"))
    if not open_.isEmpty():
        done = done.unionByName(settle(_descend(open_, spots, own, low, levels, bool(apart), False).drop("want")))
    return _back(points, done, key, apart, [])


def _left(asked: DataFrame, found: DataFrame) -> DataFrame:
    side = found.withColumnsRenamed({**{a: f"_{a}" for a in AXES}, "g": "_g"})
    on = F.col("g").eqNullSafe(F.col("_g"))
    for a in AXES:
        on = on & (F.col(a) == F.col(f"_{a}"))
    return asked.join(side, on, "left").select(*AXES, "g", "dist")


def nearest_by(points: DataFrame, targets: DataFrame, key: str, group: str) -> DataFrame:
    """(key, group, dist): the distance from each point to the nearest target of every group of
    targets, few groups that a layout fixes.  Points without coordinates have no row."""
    spots = settle(_places(targets, group).distinct())
    if spots.isEmpty():
        return points.select(key, targets[group], F.lit(None).cast("double").alias("dist")).limit(0)
    cell, low, levels = spacing(spots)
    groups = spots.select(F.col("g").alias("want")).distinct()
    asked = _places(points, None).distinct().crossJoin(F.broadcast(groups)).withColumn("u", F.lit(None).cast("double"))
    found = _descend(asked, spots, cell, low, levels, False, True)
    return _back(points, found, key, None, ["want"]).filter("want is not null").withColumnRenamed("want", group)
