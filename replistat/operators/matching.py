"""Matching objects across timepoints, finding duplicates across fields, pairing files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.geometry import growth, num
from ..params import DUPLICATE_DISTANCE_PX, PairGate
from ..session import cut_lineage, unless_large
from .assignment import best_matching
from .gates import REJECTED, pair_gate
from .graph import connected_components, greedy_losers
from .near import near_pairs
from .scan import row_numbers


def mark_matched(manifest: DataFrame, key: str, timepoint: str, name: str = "is_matched_pair") -> DataFrame:
    """Flag rows whose key occurs at two or more timepoints."""
    per = manifest.groupBy(key).agg((F.count_distinct(timepoint) >= 2).alias(name)).withColumnRenamed(key, "_k")
    return manifest.join(per, F.col(key) == F.col("_k")).drop("_k")


def matched_keys(manifest: DataFrame, key: str, timepoint: str, first: str = "t0", second: str = "t7") -> DataFrame:
    """Every key with ``matched``, ``only_first`` or ``only_second``."""
    per = manifest.groupBy(key).agg(
        F.bool_or(F.col(timepoint) == first).alias("_a"), F.bool_or(F.col(timepoint) == second).alias("_b"))
    state = F.when(F.col("_a") & F.col("_b"), "matched").when(F.col("_a"), "only_first").when(
        F.col("_b"), "only_second")
    return per.select(key, state.alias("state")).filter(F.col("state").isNotNull())


# ----------------------------------------------------------------------------- timepoint matching

def admissible_edges(t0: DataFrame, t7: DataFrame, key: str, gate: PairGate = PairGate(), x="centroid_x",
                     y="centroid_y", d="equivalent_diameter_px", flag: str | None = "qc_flag", stored: bool = False) -> DataFrame:
    """Pairs of a key's two timepoints whose distance is within the displacement limit.

    Columns ``a_*`` and ``b_*`` and ``distance``; rejected objects never compete. ``stored``: see ``near_pairs``.
    """
    def ready(df: DataFrame) -> DataFrame:
        if flag:
            df = df.filter(~F.col(flag).isin(*REJECTED))
        reach = F.greatest(F.lit(gate.min_displacement_px), num(d) * (gate.radius_factor / 2.0))
        return df.withColumn("_reach", reach)

    def limit(a, b) -> Column:
        return F.greatest(F.lit(gate.min_displacement_px), (a(d) + b(d)) / 4.0 * gate.radius_factor)

    return near_pairs(ready(t0), ready(t7), [key], x, y, "_reach", limit, stored=stored).drop("a__reach", "b__reach")


def lone_edges(edges: DataFrame, a: str, b: str) -> tuple[DataFrame, DataFrame]:
    """Split edges into those that are a whole component on their own and the rest."""
    both = _degrees(edges, a, b)
    lone = (F.col("_da") == 1) & (F.col("_db") == 1)
    return both.filter(lone).drop("_da", "_db"), both.filter(~lone).drop("_da", "_db")


def _degrees(edges: DataFrame, a: str, b: str) -> DataFrame:
    """Edges with the number of edges at each end, ``_da`` and ``_db``."""
    edges = unless_large(cut_lineage(edges))      # read three times below; many rows are never broadcast
    da = edges.groupBy(a).agg(F.count(F.lit(1)).alias("_da")).withColumnRenamed(a, "_ka")
    db = edges.groupBy(b).agg(F.count(F.lit(1)).alias("_db")).withColumnRenamed(b, "_kb")
    return edges.join(da, F.col(a) == F.col("_ka")).join(db, F.col(b) == F.col("_kb")).drop("_ka", "_kb")


def _stars(edges: DataFrame, last: bool = False) -> tuple[DataFrame, DataFrame]:
    """The best edge of every component whose edges share one end, and all edges of the other components.

    Such a component offers one pair: its shortest edge, the smaller id at equal distances (``last``: the larger ``a_id``).
    """
    best = [c for c in edges.columns if c not in ("_da", "_db")]
    marked = unless_large(cut_lineage(_degrees(edges, "a_id", "b_id")))
    over_a = marked.groupBy("a_id").agg(F.max("_db").alias("_m"), F.min(F.struct("distance", "b_id")).alias("_e")).filter("_m = 1")
    nearest = F.max(F.struct((-F.col("distance")).alias("_near"), "distance", "a_id")) if last else F.min(F.struct("distance", "a_id"))
    over_b = marked.groupBy("b_id").agg(F.max("_da").alias("_m"), F.count(F.lit(1)).alias("_k"), nearest.alias("_e")).filter("_m = 1 AND _k > 1")
    picked = over_a.select("a_id", F.col("_e.b_id").alias("b_id"), F.col("_e.distance").alias("distance")).unionByName(
        over_b.select(F.col("_e.a_id").alias("a_id"), "b_id", F.col("_e.distance").alias("distance")))
    rest = marked.join(over_a.select("a_id"), "a_id", "left_anti").join(over_b.select("b_id"), "b_id", "left_anti")
    return picked.select(*best), rest.select(*best)


def _assignment():
    """Grouped function: most pairs first, then least total distance, on every small component of a group."""
    def solve(pdf):
        from itertools import groupby

        import pandas as pd

        pdf = pdf.sort_values(["component", "a_id", "b_id"])
        rows = zip(pdf["component"], pdf["a_id"], pdf["b_id"], pdf["distance"])
        hits = [hit for _, part in groupby(rows, key=lambda r: r[0]) for hit in one([r[1:] for r in part])]
        return pd.DataFrame(hits, columns=["a_id", "b_id", "distance"])

    def one(edges):
        import heapq

        left = {v: i for i, v in enumerate(dict.fromkeys(a for a, _, _ in edges))}
        right = {v: i for i, v in enumerate(sorted({b for _, b, _ in edges}))}
        rows = [dict() for _ in left]
        for a, b, d in edges:
            rows[left[a]][right[b]] = d
        row_of, col_of = [-1] * len(right), [-1] * len(left)
        pot_l, pot_r = [0.0] * len(left), [0.0] * len(right)
        while True:
            # cheapest path from any free row to any free column (Dijkstra on reduced costs)
            dist, via, done = {}, {}, set()
            start = {i: 0.0 - pot_l[i] for i in range(len(left)) if col_of[i] < 0}
            shift = min(start.values(), default=0.0)
            heap = [(v - shift, 0, i) for i, v in start.items()]
            dist = {(0, i): v - shift for i, v in start.items()}
            heapq.heapify(heap)
            while heap:
                cost, side, u = heapq.heappop(heap)
                if (side, u) in done:
                    continue
                done.add((side, u))
                if side == 0:
                    steps = ((1, j, max(0.0, w + pot_l[u] - pot_r[j])) for j, w in rows[u].items() if col_of[u] != j)
                elif row_of[u] >= 0:
                    steps = ((0, row_of[u], 0.0),)
                else:
                    steps = ()
                for s, v, w in steps:
                    if cost + w < dist.get((s, v), float("inf")):
                        dist[(s, v)] = cost + w
                        via[(s, v)] = (side, u)
                        heapq.heappush(heap, (cost + w, s, v))
            ends = [(dist[(1, j)] + pot_r[j], j) for j in range(len(right)) if row_of[j] < 0 and (1, j) in dist]
            if not ends:
                break
            far = max(dist.values())
            for i in range(len(left)):
                pot_l[i] += dist.get((0, i), far)
            for j in range(len(right)):
                pot_r[j] += dist.get((1, j), far)
            _, j = min(ends)
            node = (1, j)
            while node is not None:
                i = via[node][1]
                previous = col_of[i]
                col_of[i], row_of[node[1]] = node[1], i
                node = (1, previous) if previous >= 0 else None
        names_l, names_r = list(left), sorted(right, key=right.get)
        return [(names_l[i], names_r[j], rows[i][j]) for i, j in enumerate(col_of) if j >= 0]

    return solve


def _latest(solve):
    """The solver's matching, changed to later ``a_id`` as long as the total, added up in their order, stays the same.

    A free end takes the place of the earliest one it can push out along a path that costs nothing.
    """
    def again(pdf):
        import pandas as pd

        out, back = {}, {}
        for a, b, d in zip(pdf["a_id"], pdf["b_id"], pdf["distance"]):
            out.setdefault(a, {})[b] = d
            back.setdefault(b, []).append(a)
        found = solve(pdf)
        mate = dict(zip(found["a_id"], found["b_id"]))
        owner = {b: a for a, b in mate.items()}
        for free in sorted(out, reverse=True):
            if free in mate:
                continue
            cost, via, queue = {free: 0.0}, {}, [free]
            for a in queue:
                for b, d in out[a].items():
                    o = owner.get(b)
                    if o is not None and o != a and o != free and cost[a] + d - out[o][b] < cost.get(o, float("inf")) - 1e-9:
                        cost[o], via[o] = cost[a] + d - out[o][b], (a, b)
                        queue.append(o)
            could = sorted(o for o, c in cost.items() if abs(c) < 1e-9 and o < free)
            part = _reached(free, out, back) if could else set()
            for gone in could:
                new, o = {}, gone
                while o != free:
                    a, b = via[o]
                    new[a] = b
                    o = a
                if _total({**{a: mate[a] for a in part if a in mate and a != gone}, **new}, out) <= _total({a: mate[a] for a in part if a in mate}, out):
                    del mate[gone]
                    mate.update(new)
                    owner.update({b: a for a, b in new.items()})
                    break
        return pd.DataFrame([(a, b, out[a][b]) for a, b in mate.items()], columns=["a_id", "b_id", "distance"])

    return again


def _total(mate: dict, out: dict) -> float:
    total = 0.0
    for a in sorted(mate):
        total += out[a][mate[a]]
    return total


def _reached(a, out: dict, back: dict) -> set:
    """All first ends in the component of ``a``."""
    seen, todo = {a}, [a]
    for x in todo:
        for b in out[x]:
            new = [y for y in back[b] if y not in seen]
            seen.update(new)
            todo += new
    return seen


#: Edges of small components that one call of the solver gets, about.
SOLVER_ROWS = 5_000


def optimal_matching(edges: DataFrame, a: str, b: str, distance: str = "distance", one_task: int = 20_000, last: bool = False) -> DataFrame:
    """Best matching of an edge table: as many pairs as possible, then the least total distance.

    The optimum splits over connected components. Those whose edges share one end, nearly all in practice,
    never leave Spark expressions; those of up to ``one_task`` edges go to a small solver, many components in a call;
    larger ones are reduced in rounds over all of Spark (``assignment``).

    ``last``: where equal optima pair different ``a`` with the same ``b``, the later ``a`` (not in the rounds).
    """
    edges = edges.select(F.col(a).alias("a_id"), F.col(b).alias("b_id"), F.col(distance).alias("distance"))
    plain, rest = _stars(edges, last)
    rest = unless_large(cut_lineage(rest))
    tag = lambda side, c: F.struct(F.lit(side).alias("side"), F.col(c).alias("id"))
    tagged = rest.select(tag(0, "a_id").alias("_p"), tag(1, "b_id").alias("_q"))
    nodes = tagged.select(F.col("_p").alias("_node")).unionByName(tagged.select(F.col("_q").alias("_node")))
    comp = connected_components(nodes, tagged, "_node", "_p", "_q")
    comp = comp.filter("_node.side = 0").select(F.col("_node.id").alias("_a"), F.col("component.id").alias("component"))
    rest = unless_large(cut_lineage(rest.join(comp, F.col("a_id") == F.col("_a")).select("component", "a_id", "b_id", "distance")))
    large = unless_large(cut_lineage(rest.groupBy("component").agg(F.count(F.lit(1)).alias("_m")).filter(F.col("_m") > one_task).select("component")))
    if not large.isEmpty():
        reduced = best_matching(rest.join(large, "component", "left_semi"))
        plain, rest = plain.unionByName(reduced), rest.join(large, "component", "left_anti")
    calls = rest.count() // SOLVER_ROWS + 1
    dealt = rest.withColumn("_call", F.pmod(F.xxhash64("component"), F.lit(calls))).repartition(calls, "_call")
    solved = dealt.groupBy("_call").applyInPandas(_latest(_assignment()) if last else _assignment(), plain.schema)
    return plain.unionByName(solved).select(F.col("a_id").alias(a), F.col("b_id").alias(b), F.col("distance").alias(distance))


def greedy_matching(edges: DataFrame, a: str, b: str, a_order: str, b_order: str, distance: str = "distance") -> DataFrame:
    """Rows in order, each takes its nearest free column.

    A row is settled when no earlier open row could still take the column it wants; all such rows
    are settled in one round, so no group is ever walked row by row.
    """
    todo = unless_large(cut_lineage(edges.select(F.col(a).alias("_a"), F.col(b).alias("_b"), F.col(a_order).alias("_ao"),
                                    F.col(b_order).alias("_bo"), F.col(distance).alias("_d"))))
    taken = todo.limit(0)
    while not todo.isEmpty():
        want = todo.groupBy("_a").agg(F.min(F.struct("_d", "_bo", "_b")).alias("_w")).select(
            F.col("_a").alias("_wa"), F.col("_w._b").alias("_wb"))
        earliest = todo.groupBy("_b").agg(F.min(F.struct("_ao", "_a")).alias("_e")).select(
            F.col("_b").alias("_eb"), F.col("_e._a").alias("_ea"))
        now = unless_large(cut_lineage(
            todo.join(want, (F.col("_a") == F.col("_wa")) & (F.col("_b") == F.col("_wb")))
            .join(earliest, (F.col("_b") == F.col("_eb")) & (F.col("_a") == F.col("_ea")))
            .select(*todo.columns)))
        taken = taken.unionByName(now)
        used = now.select(F.col("_a").alias("_ua"), F.col("_b").alias("_ub"))
        todo = unless_large(cut_lineage(todo.join(used, F.col("_a") == F.col("_ua"), "left_anti")
                           .join(used, F.col("_b") == F.col("_ub"), "left_anti")))
    return taken.select(F.col("_a").alias(a), F.col("_b").alias(b), F.col("_d").alias(distance))


PAIR_SIDE = ("object_id", "centroid_x", "centroid_y", "equivalent_diameter_um", "volume_sphere_um3",
             "volume_ellipsoid_um3", "circularity", "qc_flag")
_SIDE_NAMES = {"equivalent_diameter_um": "eq_diameter_um"}


def pair_table(t0: DataFrame, t7: DataFrame, matches: DataFrame, order: str = "label_idx",
               gate: PairGate = PairGate()) -> DataFrame:
    """Full pair rows from matches ``(t0_object_id, t7_object_id, centroid_distance_px)``."""
    def side(df: DataFrame, p: str, more: Sequence[str] = ()) -> DataFrame:
        return df.select(*more, *[F.col(c).alias(f"{p}_{_SIDE_NAMES.get(c, c)}") for c in PAIR_SIDE])

    j = matches.join(side(t0, "t0", ["pair_key", "condition", "replicate", "fov", F.col(order).alias("_ord")]),
                     "t0_object_id").join(side(t7, "t7"), "t7_object_id")
    change = growth("t0_volume_sphere_um3", "t7_volume_sphere_um3", "t0_eq_diameter_um", "t7_eq_diameter_um")
    j = pair_gate(j.withColumns(change), gate)
    j = row_numbers(j, ["pair_key"], ["_ord", "t0_object_id"], "_n")
    return j.withColumn("pair_id", F.concat(F.col("pair_key"), F.lit("_pair"), F.col("_n").cast("string"))).drop("_n", "_ord")


def assign_pair_ids(objects: DataFrame, pairs: DataFrame, object_id: str = "object_id", flag: str = "qc_flag") -> DataFrame:
    """Add ``pair_id``; rejected and unmatched objects get ``UNPAIRED``, the t0 mapping wins."""
    ends = pairs.select(F.explode(F.array(
        F.struct(F.col("t0_object_id").alias("_oid"), F.lit(0).alias("_side"), F.col("pair_id").alias("_pid")),
        F.struct(F.col("t7_object_id").alias("_oid"), F.lit(1).alias("_side"), F.col("pair_id").alias("_pid")),
    )).alias("e")).select("e.*").groupBy("_oid").agg(F.min_by("_pid", "_side").alias("_pid"))
    j = objects.join(ends, F.col(object_id) == F.col("_oid"), "left")
    pid = F.when(F.col(flag).isin(*REJECTED), F.lit("UNPAIRED")).otherwise(F.coalesce("_pid", F.lit("UNPAIRED")))
    return j.withColumn("pair_id", pid).drop("_oid", "_pid")


def duplicate_ids(objects: DataFrame, object_id: str = "object_id") -> DataFrame:
    """Ids that occur more than once; empty for a valid table."""
    return objects.groupBy(object_id).agg(F.count(F.lit(1)).alias("n_rows")).filter(F.col("n_rows") > 1)


# ----------------------------------------------------------------------------- duplicates

def duplicate_edges(objects: DataFrame, group: Sequence[str], field: str, object_id: str, order: str,
                    x="centroid_x", y="centroid_y", max_px: float = DUPLICATE_DISTANCE_PX,
                    max_um: float | None = None, px_um: str = "pixel_size_um",
                    flag: str | None = "qc_flag") -> DataFrame:
    """Pairs of accepted objects in one group but different fields that lie within the threshold.

    ``a`` is the earlier object. With ``max_um`` the distance is scaled by the mean pixel size.
    """
    if flag:
        objects = objects.filter(F.col(flag).isin("PASS", "REVIEW"))
    reach = F.lit(float(max_px)) if max_um is None else F.lit(float(max_um)) / num(px_um)
    ready = objects.withColumn("_reach", reach)

    def limit(a, b) -> Column:
        if max_um is None:
            return F.lit(float(max_px))
        return F.lit(float(max_um)) / ((a(px_um) + b(px_um)) * 0.5)

    def different(a, b) -> Column:
        return (a(field) != b(field)) & (F.struct(a(order), a(object_id)) < F.struct(b(order), b(object_id)))

    return near_pairs(ready, ready, group, x, y, "_reach", limit, different)


def loser_id(object_id: str, contrast: str = "contrast_ratio", circularity: str = "circularity",
             margin: float = 0.02) -> Column:
    """Which end of a duplicate edge loses: lower contrast, else lower circularity (tie: the later)."""
    by_contrast = F.col("a_" + contrast) - F.col("b_" + contrast)
    by_shape = F.col("a_" + circularity) - F.col("b_" + circularity)
    a_wins = F.when(F.abs(by_contrast) > margin, by_contrast > 0).otherwise(by_shape >= 0)
    return F.when(a_wins, F.col("b_" + object_id)).otherwise(F.col("a_" + object_id))


def resolve_duplicates(edges: DataFrame, object_id: str, order: str) -> DataFrame:
    """Losers with the winner that displaced them, in order of distance."""
    cols = [F.col("a_" + object_id).alias("a"), F.col("b_" + object_id).alias("b"),
            F.col("a_" + order).alias("_oa"), F.col("b_" + order).alias("_ob"), "distance",
            loser_id(object_id).alias("_l")]
    done = greedy_losers(edges.select(*cols), "a", "b", ["distance", "_oa", "_ob", "a", "b"], F.col("_l"), ["distance"])
    winner = F.when(F.col("loser") == F.col("a"), F.col("b")).otherwise(F.col("a"))
    return done.select("loser", winner.alias("winner"), "distance")


def drop_duplicates_across_fields(objects: DataFrame, losers: DataFrame, object_id: str = "object_id",
                                  field: str = "fov", flag: str = "qc_flag", codes: str = "qc_codes") -> DataFrame:
    """Set losers to FAIL and record ``duplicate_focal_plane`` with the field of the winner."""
    win = objects.select(F.col(object_id).alias("winner"), F.col(field).alias("_wf"))
    mark = losers.join(win, "winner").select(F.col("loser").alias("_l"), F.col("winner").alias("duplicate_of"),
                                             F.col("_wf").alias("duplicate_field"))
    j = objects.join(mark, F.col(object_id) == F.col("_l"), "left")
    lost = F.col("_l").isNotNull()
    return j.withColumn(flag, F.when(lost, F.lit("FAIL")).otherwise(F.col(flag))).withColumn(
        codes, F.when(lost, F.concat(F.col(codes), F.array(F.lit("duplicate_focal_plane")))).otherwise(F.col(codes))
    ).drop("_l")


def _field_counts(objects: DataFrame, well: Sequence[str], field: str, other_field: Column) -> DataFrame:
    """Objects per well, field and other field (``_of``), in one pass; many rows are never broadcast."""
    return unless_large(cut_lineage(objects.groupBy(*well, field, other_field.alias("_of")).agg(F.count(F.lit(1)).alias("_n"))))


def field_links(objects: DataFrame, well: Sequence[str], field: str, other_field: Column,
                min_share: float = 0.65, min_links: int = 3) -> DataFrame:
    """Pairs of fields of a well joined by enough duplicates (columns ``f1 < f2``)."""
    return _links(_field_counts(objects, well, field, other_field), well, field, min_share, min_links)


def _links(counts: DataFrame, well: Sequence[str], field: str, min_share: float = 0.65, min_links: int = 3) -> DataFrame:
    size = counts.groupBy(*well, field).agg(F.sum("_n").alias("_n"))
    links = (
        counts.filter(F.col("_of").isNotNull() & (F.col("_of") != F.col(field)))
        .groupBy(*well, F.least(field, "_of").alias("f1"), F.greatest(field, "_of").alias("f2"))
        .agg(F.sum("_n").alias("n_links")))
    n1 = size.withColumnRenamed(field, "f1").withColumnRenamed("_n", "_n1")
    n2 = size.withColumnRenamed(field, "f2").withColumnRenamed("_n", "_n2")
    j = links.join(n1, [*well, "f1"]).join(n2, [*well, "f2"])
    enough = (F.col("n_links") / F.least("_n1", "_n2") >= min_share) | (F.col("n_links") >= min_links)
    return j.filter(enough).select(*well, "f1", "f2", "n_links")


def effective_fields(objects: DataFrame, well: Sequence[str], field: str, other_field: Column) -> DataFrame:
    """Number of distinct physical fields per well: linked fields count once."""
    counts = _field_counts(objects, well, field, other_field)
    tag = lambda f: F.struct(*[F.col(w) for w in well], F.col(f).alias("_f"))
    nodes = counts.select(*well, field).distinct().select(tag(field).alias("_node"))
    comp = connected_components(nodes, _links(counts, well, field).select(tag("f1").alias("_p"), tag("f2").alias("_q")), "_node", "_p", "_q")
    return comp.groupBy(*[F.col("_node")[w].alias(w) for w in well]).agg(
        F.count_distinct("component").alias("n_fields"))


# ----------------------------------------------------------------------------- file pairing

def pair_channels(files: DataFrame, base: str, channel: str, name: str, first: str = "00", second: str = "02") -> DataFrame:
    """One row per base with both channel files, how many files claimed each, and a state."""
    per = files.filter(F.col(channel).isin(first, second)).groupBy(base).agg(
        F.min(F.when(F.col(channel) == first, F.col(name))).alias("first_file"),
        F.min(F.when(F.col(channel) == second, F.col(name))).alias("second_file"),
        F.count_if(F.col(channel) == first).alias("n_first"),
        F.count_if(F.col(channel) == second).alias("n_second"))
    state = (
        F.when((F.col("n_first") > 1) | (F.col("n_second") > 1), "collision")
        .when(F.col("n_first") == 0, "missing_first")
        .when(F.col("n_second") == 0, "missing_second").otherwise("paired"))
    return per.withColumn("state", state)


def field_state(pairs: DataFrame, shape_a: Column, shape_b: Column, px_a: Column, px_b: Column,
                calibrated_a: Column, calibrated_b: Column, tolerance: float = 0.01) -> DataFrame:
    """Refine ``paired`` rows: shapes must agree, and calibrated pixel sizes within one percent."""
    bad_px = calibrated_a & calibrated_b & (F.abs(px_b - px_a) > tolerance * px_a)
    state = (F.when(F.col("state") != "paired", F.col("state"))
             .when(shape_a != shape_b, "shape_mismatch").when(bad_px, "pixel_size_mismatch").otherwise("paired"))
    return pairs.withColumn("state", state)


def qualify_materials(fields: DataFrame, cell_line: str = "cell_line", day: str = "day", material: str = "material") -> DataFrame:
    """Prefix the material with cell line and day when the data hold more than one such group."""
    groups = fields.agg((F.count_distinct(F.struct(cell_line, day)) > 1).alias("many")).scalar()
    full = F.concat(F.col(cell_line), F.lit("_D"), F.col(day), F.lit("_"), F.col(material))
    return fields.withColumn("_many", groups).withColumn(
        material, F.when(F.col("_many"), full).otherwise(F.col(material))).drop("_many")


def choose_override(images: DataFrame, masks: DataFrame, image: str, pair_key: str, timepoint: str, name: str) -> DataFrame:
    """The first existing manual mask per image among the accepted file names, in fixed priority."""
    stem, key = F.col(image).cast("string"), F.concat_ws("_", F.col(pair_key), F.col(timepoint))
    names = [F.concat(s, F.lit(tail)) for ext in (".png", ".tif", ".tiff")
             for s, tail in ((stem, ext), (stem, "_mask" + ext), (key, ext), (key, "_mask" + ext))]
    wanted = images.select(F.col(image).alias("_img"), F.posexplode(F.array(*names)).alias("_prio", "_name"))
    hit = wanted.join(masks.select(F.col(name).alias("_name")).distinct(), "_name").groupBy("_img").agg(
        F.min_by("_name", "_prio").alias("manual_mask"))
    j = images.join(hit, F.col(image) == F.col("_img"), "left").drop("_img")
    return j.withColumn("mask_source", F.when(F.col("manual_mask").isNotNull(), "manual_review").otherwise("automated"))


def radial_distance(objects: DataFrame, extents: DataFrame, image: str, x: str, y: str, cx: str, cy: str, radius: str) -> DataFrame:
    """Distance of every object to its field's centre in units of the field's radius (at least 1)."""
    e = extents.select(F.col(image).alias("_img"), F.col(cx).alias("_cx"), F.col(cy).alias("_cy"), F.col(radius).alias("_r"))
    j = objects.join(e, F.col(image) == F.col("_img"), "left")
    d = F.sqrt(F.pow(F.col(x) - F.col("_cx"), 2) + F.pow(F.col(y) - F.col("_cy"), 2))
    out = F.when(num("_r") > 0, d / F.greatest(F.lit(1.0), F.col("_r")))
    return j.withColumn("normalized_radial_distance", out).drop("_img", "_cx", "_cy", "_r")
