"""Positional differences. A letter differs from another if both are there and are not equal.

Strategies for all pairs, which give the same rows:

``join``    self-join of the position table on the position; the plainest.
``group``   one row a position with all its letters; positions on which all agree are dropped before pairs are formed.
``allele``  one row a position and letter with the sequences that hold it; unequal letters of a position are joined.
``block``   sequences cut into blocks; only blocks that are not equal are taken apart.
``consensus``  each sequence kept as its deviations from the commonest letter of a position; pairs come from deviations, so letters on which all agree
            cost one comparison of blocks with the consensus and are never shuffled one by one.

A plan of pairs enters the join: its rows meet the blocks of the first, then those of the second, so the cost follows the plan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lockstep.functions.text import any_differs, equal_as_sign, letters
from lockstep.operators import packed
from lockstep.operators.packed import blocks
from lockstep.operators.positions import explode_positions
from lockstep.sources.shared import written

PAIR_COLUMNS = ("first_index", "second_index", "Index", "first_letter", "second_letter")
BLOCK, ROLL = 256, 4096
BROADCAST_ROWS, BROADCAST_BLOCKS = 1_000_000, 100_000


def diff_pairs(sequences: DataFrame, strategy: str = "allele", plan: DataFrame | None = None) -> DataFrame:
    """``PAIR_COLUMNS`` of all pairs ``i < j``, or of the pairs in ``plan(first_index, second_index)``, each once, however they are ordered. A plan is
    followed block by block, whatever the strategy. ``block``, ``consensus`` and plans also take blocks of ``BLOCK`` letters (``seq_index, block, part``) for sequences."""
    strategies = {"join": _by_join, "group": _by_group, "allele": _by_allele, "block": _by_block, "consensus": _by_consensus}
    found = strategies[strategy](sequences) if plan is None else _by_plan(sequences, plan)
    return found.select(*PAIR_COLUMNS)


def _by_join(sequences: DataFrame) -> DataFrame:
    a, b = (explode_positions(sequences).alias(x) for x in "ab")
    on = (F.col("a.Index") == F.col("b.Index")) & (F.col("a.seq_index") < F.col("b.seq_index")) & (F.col("a.letter") != F.col("b.letter"))
    return a.join(b, on).select(F.col("a.seq_index").alias("first_index"), F.col("b.seq_index").alias("second_index"), "a.Index", F.col("a.letter").alias("first_letter"), F.col("b.letter").alias("second_letter"))


def diff_pairs_outer_form(sequences: DataFrame) -> DataFrame:
    """The same as a full outer join whose one-sided rows are filtered away; the optimizer makes it an inner join."""
    a, b = (explode_positions(sequences).alias(x) for x in "ab")
    on = (F.col("a.Index") == F.col("b.Index")) & (F.col("a.seq_index") < F.col("b.seq_index")) & (F.col("a.letter") != F.col("b.letter"))
    both = a.join(b, on, "full_outer").filter(F.col("a.Index").isNotNull() & F.col("b.Index").isNotNull())
    return both.select(F.col("a.seq_index").alias("first_index"), F.col("b.seq_index").alias("second_index"), "a.Index", F.col("a.letter").alias("first_letter"), F.col("b.letter").alias("second_letter"))


def varying_positions(sequences: DataFrame) -> DataFrame:
    """``Index, held``: the letters (with their sequences, in order) of positions on which not all agree."""
    held = F.sort_array(F.collect_list(F.struct("seq_index", "letter")))
    return explode_positions(sequences).groupBy("Index").agg(held.alias("held"), F.min("letter").alias("low"), F.max("letter").alias("high")).filter("low <> high").drop("low", "high")


def _by_group(sequences: DataFrame) -> DataFrame:
    each = varying_positions(sequences).select("Index", "held", F.posexplode("held").alias("k", "x"))
    later = F.filter(F.slice("held", F.col("k") + 2, F.size("held")), lambda y: y["letter"] != F.col("x.letter"))
    pairs = each.select("Index", "x", F.explode(later).alias("y"))
    return pairs.select(F.col("x.seq_index").alias("first_index"), F.col("y.seq_index").alias("second_index"), "Index", F.col("x.letter").alias("first_letter"), F.col("y.letter").alias("second_letter"))


def _by_allele(sequences: DataFrame) -> DataFrame:
    alleles = explode_positions(sequences).groupBy("Index", "letter").agg(F.collect_list("seq_index").alias("who"))
    a, b = alleles.alias("a"), alleles.alias("b")
    met = a.join(b, (F.col("a.Index") == F.col("b.Index")) & (F.col("a.letter") < F.col("b.letter"))).select("a.Index", F.col("a.letter").alias("la"), F.col("b.letter").alias("lb"), F.col("a.who").alias("wa"), F.col("b.who").alias("wb"))
    pairs = met.select("Index", "la", "lb", F.explode("wa").alias("i"), "wb").select("Index", "la", "lb", "i", F.explode("wb").alias("j"))
    ahead = F.col("i") < F.col("j")
    pick = lambda x, y: F.when(ahead, F.col(x)).otherwise(F.col(y))
    return pairs.filter("i <> j").select(pick("i", "j").alias("first_index"), pick("j", "i").alias("second_index"), "Index", pick("la", "lb").alias("first_letter"), pick("lb", "la").alias("second_letter"))


def _opened(met: DataFrame, size: int) -> DataFrame:
    """The differing letters of pairs of blocks: ``first_index, second_index, block, x, y``. A pair costs the letters that both have, however long one of them is."""
    both = F.least(F.length("x"), F.length("y"))
    cut = lambda c: letters(F.substring(F.col(c), F.lit(1), both))
    each = met.select("first_index", "second_index", "block", F.posexplode(F.arrays_zip(cut("x").alias("x"), cut("y").alias("y"))).alias("at", "z")).filter(F.col("z.x") != F.col("z.y"))
    return each.select("first_index", "second_index", (F.col("block").cast("long") * size + F.col("at")).alias("Index"), F.col("z.x").alias("first_letter"), F.col("z.y").alias("second_letter"))


def opened_pairs(met: DataFrame, size: int = BLOCK) -> DataFrame:
    """``PAIR_COLUMNS`` of pairs of blocks ``i, j, block, x, y`` in any order; the smaller index comes first."""
    ahead = F.col("i") < F.col("j")
    pick = lambda a, b: F.when(ahead, F.col(a)).otherwise(F.col(b))
    return _opened(met.select(pick("i", "j").alias("first_index"), pick("j", "i").alias("second_index"), "block", pick("x", "y").alias("x"), pick("y", "x").alias("y")), size).select(*PAIR_COLUMNS)


def _by_block(sequences: DataFrame, size: int = BLOCK) -> DataFrame:
    a, b = (blocks(sequences, size=size).alias(x) for x in "ab")
    on = (F.col("a.block") == F.col("b.block")) & (F.col("a.seq_index") < F.col("b.seq_index")) & (F.col("a.part") != F.col("b.part"))
    return _opened(a.join(b, on).select(F.col("a.seq_index").alias("first_index"), F.col("b.seq_index").alias("second_index"), "a.block", F.col("a.part").alias("x"), F.col("b.part").alias("y")), size)


def _planned(cut: DataFrame, plan: DataFrame, unlike: Column) -> DataFrame:
    """The plan's pairs with the blocks ``a`` of the first and ``b`` of the second that ``unlike`` tells apart."""
    wanted = plan.select("first_index", "second_index").distinct().alias("p")
    first = wanted.join(cut.alias("a"), F.col("p.first_index") == F.col("a.seq_index"))
    return first.join(cut.alias("b"), (F.col("p.second_index") == F.col("b.seq_index")) & (F.col("a.block") == F.col("b.block")) & unlike)


def _by_plan(sequences: DataFrame, plan: DataFrame, size: int = BLOCK) -> DataFrame:
    met = _planned(blocks(sequences, size=size), plan, F.col("a.part") != F.col("b.part"))
    return _opened(met.select("first_index", "second_index", "a.block", F.col("a.part").alias("x"), F.col("b.part").alias("y")), size)


def consensus(cut: DataFrame) -> DataFrame:
    """``block, common``: the commonest letter of each position of a block (ties: the largest), counted before the shuffle."""
    single = cut.select("block", F.posexplode(letters(F.col("part"))).alias("at", "letter"))
    counted = single.groupBy("block", "at", "letter").agg(F.count("*").alias("n"))
    best = counted.groupBy("block", "at").agg(F.max(F.struct("n", "letter")).alias("best"))
    held = F.sort_array(F.collect_list(F.struct("at", F.col("best.letter").alias("letter"))))
    return best.groupBy("block").agg(F.array_join(F.transform(held, lambda x: x["letter"]), "").alias("common"))


def deviations(sequences: DataFrame, size: int = BLOCK) -> DataFrame:
    """``seq_index, Index, letter, common``: only the letters in which a sequence is not the consensus. Blocks of the consensus are broadcast while they are few."""
    cut = blocks(sequences, size=size)
    common = written(consensus(cut), "consensus")
    met = cut.join(F.broadcast(common) if common.count() <= BROADCAST_BLOCKS else common, "block").filter(F.col("part") != F.expr("substring(common, 1, length(part))"))
    both = met.select("seq_index", "block", F.posexplode(F.arrays_zip(letters(F.col("part")).alias("x"), letters(F.col("common")).alias("y"))).alias("at", "z")).filter(F.col("z.x") != F.col("z.y"))
    return both.select("seq_index", (F.col("block").cast("long") * size + F.col("at")).alias("Index"), F.col("z.x").alias("letter"), F.col("z.y").alias("common"))


def _by_consensus(sequences: DataFrame, size: int = BLOCK) -> DataFrame:
    """Indices must not repeat. Each position's deviations meet the roll of all sequences, cut into parts of about ``ROLL``, that reach so far."""
    held = F.collect_list(F.struct("seq_index", "letter"))
    at = deviations(sequences, size).groupBy("Index", "common").agg(held.alias("held"))
    lengths = sequences.groupBy("seq_index").agg(F.sum(F.length("part")).alias("n")) if "block" in sequences.columns else sequences.select("seq_index", F.length("seq").alias("n"))
    many = lengths.count()
    parts = max(1, -(-many // ROLL))
    roll = lengths.groupBy(F.pmod(F.xxhash64("seq_index"), F.lit(parts)).alias("part")).agg(F.collect_list(F.struct("seq_index", "n")).alias("roll"))
    met = at.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long")))).join(F.broadcast(roll) if many <= BROADCAST_ROWS else roll, "part")
    other = met.select("Index", "common", "held", F.map_from_entries("held").alias("own"), F.explode("roll").alias("s")).filter(F.col("s.n") > F.col("Index"))
    other = other.select("Index", "held", F.col("s.seq_index").alias("j"), F.try_element_at("own", F.col("s.seq_index")).alias("own"), "common")
    pairs = other.select("Index", "j", "own", F.coalesce("own", "common").alias("y"), F.explode("held").alias("d")).select("Index", F.col("d.seq_index").alias("i"), "j", F.col("d.letter").alias("x"), "y", "own")
    ahead = F.col("i") < F.col("j")
    pick = lambda x, y: F.when(ahead, F.col(x)).otherwise(F.col(y))
    pairs = pairs.filter((F.col("x") != F.col("y")) & (F.col("own").isNull() | ahead))  # two that deviate meet from both sides
    return pairs.select(pick("i", "j").alias("first_index"), pick("j", "i").alias("second_index"), "Index", pick("x", "y").alias("first_letter"), pick("y", "x").alias("second_letter"))


def count_differences(sequences: DataFrame, plan: DataFrame | None = None) -> DataFrame:
    """``first_index, second_index, n_diffs`` of the pairs ``i < j`` (or of the plan's pairs) that differ somewhere, without making the differences.

    Blocks of 64 letters are bit planes (:mod:`lockstep.operators.packed`); a pair of blocks costs a few XORs and a count of bits."""
    cut = blocks(sequences, size=packed.WORD)
    rows = packed.planes(cut, packed.alphabet(cut))
    mask = packed.differing(packed.plane_names(rows))
    if plan is None:
        met = rows.alias("a").join(rows.alias("b"), (F.col("a.block") == F.col("b.block")) & (F.col("a.seq_index") < F.col("b.seq_index")) & (mask != 0))
        met = met.select(F.col("a.seq_index").alias("first_index"), F.col("b.seq_index").alias("second_index"), mask.alias("mask"))
    else:
        met = _planned(rows, plan, mask != 0).select("first_index", "second_index", mask.alias("mask"))
    return met.groupBy("first_index", "second_index").agg(F.sum(F.bit_count("mask")).cast("long").alias("n_diffs"))


def _lines(held: DataFrame, keys: list[str], n: int, gap: str) -> DataFrame:
    """``keys, line``: from rows ``keys, rank, letter`` one text a position, with the letter of each rank at its place and ``gap`` where there is none."""
    of = held.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("rank", "letter"))).alias("held"))
    before = lambda i: F.coalesce(F.get("held", i - 1)["rank"], F.lit(-1).cast("long"))
    filled = F.transform("held", lambda x, i: F.concat(F.repeat(F.lit(gap), (x["rank"] - before(i) - 1).cast("int")), x["letter"]))
    return of.select(*keys, F.rpad(F.array_join(filled, ""), n, gap).alias("line"))


def _cut_groups(lines: DataFrame, ranks: DataFrame, n: int, step: int, gap: str, sign: bool) -> DataFrame:
    """One-vs-many rows from ``Index, line``: each first's later letters are what follows its own in the line, cut into chunks of ``step``."""
    each = lines.select("Index", "line", F.explode(F.sequence(F.lit(0), F.lit(n - 2))).alias("rank")) if n > 1 else lines.select("Index", "line", F.lit(0).alias("rank")).filter("false")
    each = each.select("Index", "rank", F.substring("line", F.col("rank") + 1, F.lit(1)).alias("first_letter"), F.substring("line", F.col("rank") + 2, F.lit(n)).alias("rest")).filter(F.col("first_letter") != gap)
    apart = lambda text: F.call_function("translate", text, F.concat("first_letter", F.lit(gap)), F.lit("")) != ""
    if step >= n - 1:
        each = each.select("Index", "rank", "first_letter", F.lit(0).cast("long").alias("chunk"), F.col("rest").alias("seconds")).filter(apart(F.col("seconds")))
    else:
        each = each.filter(apart(F.col("rest")))
        each = each.select("Index", "rank", "first_letter", F.posexplode(F.regexp_extract_all("rest", F.lit(f"(?s).{{1,{step}}}"), F.lit(0))).alias("chunk", "seconds")).filter(apart(F.col("seconds")))
    text = F.replace("seconds", "first_letter", F.lit("=")) if sign else F.col("seconds")
    split = F.split(text, "")
    found = F.when(F.contains("seconds", F.lit(gap)), F.transform(split, lambda x: F.nullif(x, F.lit(gap)))).otherwise(split)
    named = F.broadcast(ranks) if n <= BROADCAST_ROWS else ranks
    return each.select("rank", F.col("chunk").cast("long").alias("chunk"), "Index", "first_letter", found.alias("letters")).join(named, "rank").select("first_index", "chunk", "Index", "first_letter", "letters")


def _ranked(sequences: DataFrame, max_s: int | None) -> tuple[DataFrame, DataFrame, int, int]:
    """Sequences as ``rank, seq``, the table ``rank, first_index``, how many there are, and a chunk's size."""
    if max_s is not None and max_s < 1:
        raise ValueError("max_s must be at least 1")
    # the indices alone are numbered in one task: n numbers, where the result has the order of n squared rows
    order = F.row_number().over(Window.orderBy("seq_index")) - 1
    ranks = written(sequences.select("seq_index").withColumn("rank", order.cast("long")), "ranks")
    n = ranks.count()
    met = sequences.select("seq_index", "seq").join(F.broadcast(ranks) if n <= BROADCAST_ROWS else ranks, "seq_index").select("rank", "seq")
    return met, ranks.select("rank", F.col("seq_index").alias("first_index")), n, max(1, n - 1) if max_s is None else max_s


def _gap(used: list[str]) -> str:
    """A code point that is no letter here, to stand for a missing one."""
    return next(chr(c) for c in range(0xE000, 0x110000) if chr(c) not in set(used))


def one_vs_many(sequences: DataFrame, max_s: int | None = None, layout: str = "canonical", sign: bool = True) -> DataFrame:
    """``first_index, chunk, Index, first_letter, letters``: positions on which a second letter of the chunk differs from the first.

    Chunks are of the later sequences in the order of ``seq_index``, which need not be without gaps but must not repeat. Equal letters are written
    ``=``; missing ones are null, or left out in the ``compact`` layout.

    Blocks packed into bits tell which positions vary; only the letters of those are opened. Each such position becomes one text with a letter a
    sequence, from which all its rows are cut by text functions. So a row holds a letter for each sequence at most."""
    ranked, ranks, n, step = _ranked(sequences, max_s)
    cut = blocks(ranked, "rank", packed.WORD)
    used = packed.alphabet(cut)
    masks = written(packed.varying_masks(packed.planes(cut, used, "rank")).select("block", packed.places(F.col("mask")).alias("places")), "masks")
    kept = cut.join(F.broadcast(masks) if masks.count() <= BROADCAST_BLOCKS else masks, "block").select("rank", "block", "part", F.explode("places").alias("at"))
    kept = kept.filter(F.col("at") < F.length("part")).select((F.col("block").cast("long") * packed.WORD + F.col("at")).alias("Index"), "rank", F.substring("part", F.col("at") + 1, F.lit(1)).alias("letter"))
    gap = _gap(used)
    found = _cut_groups(_lines(kept, ["Index"], n, gap), ranks, n, step, gap, sign)
    return found.withColumn("letters", F.filter("letters", lambda x: x.isNotNull())) if layout == "compact" else found


def keep_differing(groups: DataFrame) -> DataFrame:
    """Rows on which at least one second letter is there and is not the first."""
    return groups.filter(any_differs(F.col("first_letter"), F.col("letters")))


def substitute_equal(groups: DataFrame) -> DataFrame:
    return groups.withColumn("letters", equal_as_sign(F.col("first_letter"), F.col("letters")))


def diff_by_group(sequences: DataFrame, max_s: int | None = None) -> DataFrame:
    """The rows of :func:`one_vs_many` by one aggregation on the position: each sequence is opened once, whatever number of groups it is in,
    a position's letters are merged once, in order of the sequences, and every group's row is cut from them."""
    ranked, ranks, n, step = _ranked(sequences, max_s)
    gap = _gap(packed.alphabet(blocks(ranked, "rank")))
    single = explode_positions(ranked.withColumnRenamed("rank", "seq_index")).withColumnRenamed("seq_index", "rank")
    return _cut_groups(_lines(single, ["Index"], n, gap), ranks, n, step, gap, True)


def diff_counts(pairs: DataFrame, plan: DataFrame) -> DataFrame:
    """``first_index, second_index, n_diffs`` of every pair of the plan, zeros too."""
    counted = pairs.groupBy("first_index", "second_index").agg(F.count("*").alias("n"))
    return plan.join(counted, ["first_index", "second_index"], "left").select("first_index", "second_index", F.coalesce("n", F.lit(0)).alias("n_diffs"))


def with_zeros(counted: DataFrame, plan: DataFrame) -> DataFrame:
    """Counts (``first_index, second_index, n_diffs``) of every pair of the plan, zeros too."""
    return plan.select("first_index", "second_index").join(counted, ["first_index", "second_index"], "left").select("first_index", "second_index", F.coalesce("n_diffs", F.lit(0).cast("long")).alias("n_diffs"))
