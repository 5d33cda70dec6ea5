"""The positional operators on the worked example, on edge cases, and against plain Python."""

import os
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lockstep.compare import compare_files
from lockstep.functions import text as tx
from lockstep.operators import diff, layout, packed, positions, sinks
from lockstep.plans import groups
from lockstep.sources import fasta, manifest, shared
from lockstep.streaming import incremental

MICRO = ["AAAAA", "ACGAA", "GAGCA", "ATAAAT"]
STRATEGIES = ("join", "group", "allele", "block", "consensus")


def sequences(spark, texts):
    return spark.createDataFrame([(i, f"{i + 1}.fasta", t) for i, t in enumerate(texts)], "seq_index long, seq_id string, seq string")


def counted(spark, n):
    return spark.createDataFrame([(n,)], "n_sequences long")


def plain_pairs(texts):
    return sorted((i, j, k, a, b) for i, x in enumerate(texts) for j, y in enumerate(texts) if i < j for k, (a, b) in enumerate(zip(x, y)) if a != b)


def plain_groups(texts, max_s):
    out = []
    for i, x in enumerate(texts):
        later = list(range(i + 1, len(texts)))
        for c in range(0, len(later), max_s):
            for k, a in enumerate(x):
                seconds = [texts[j][k] if k < len(texts[j]) else None for j in later[c : c + max_s]]
                if any(b is not None and b != a for b in seconds):
                    out.append((i, c // max_s, k, a, ["=" if b == a else b for b in seconds]))
    return out


def plain_counts(pairs):
    return {(*k, n) for k, n in Counter(x[:2] for x in pairs).items()}


def rows(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("strategy", STRATEGIES)
def test_pairs_of_the_worked_example(spark, strategy):
    assert rows(diff.diff_pairs(sequences(spark, MICRO), strategy)) == plain_pairs(MICRO)


def test_one_vs_many_of_the_worked_example(spark):
    found = [(r.first_index, r.chunk, r.Index, r.first_letter, r.letters) for r in diff.one_vs_many(sequences(spark, MICRO)).collect()]
    first = sorted(x[2:] for x in found if x[0] == 0)
    assert first == [(0, "A", ["=", "G", "="]), (1, "A", ["C", "=", "T"]), (2, "A", ["G", "G", "="]), (3, "A", ["=", "C", "="])]
    assert sorted(found, key=str) == sorted(plain_groups(MICRO, 3), key=str)


@pytest.mark.parametrize("seed", range(3))
def test_random_sequences(spark, seed):
    rng = random.Random(seed)
    texts = ["".join(rng.choice("ACGTN-é🙂") for _ in range(rng.choice((0, 1, 7, 300, 600)))) for _ in range(7)] + [""]
    seqs, expected = sequences(spark, texts), plain_pairs(texts)
    for strategy in STRATEGIES:
        assert rows(diff.diff_pairs(seqs, strategy).select(*diff.PAIR_COLUMNS)) == expected
    assert rows(diff.diff_pairs_outer_form(seqs)) == expected
    for max_s in (1, 2, 3, 50):
        found = [tuple(r) for r in diff.one_vs_many(seqs, max_s).select("first_index", "chunk", "Index", "first_letter", "letters").collect()]
        assert sorted(found, key=str) == sorted(plain_groups(texts, max_s), key=str)
        merged = diff.diff_by_group(seqs, max_s).select("first_index", "chunk", "Index", "first_letter", "letters")
        assert sorted(map(str, map(tuple, merged.collect()))) == sorted(map(str, plain_groups(texts, max_s)))
    assert {tuple(r) for r in diff.count_differences(seqs).collect()} == plain_counts(expected)


def test_properties(spark):
    assert rows(diff.diff_pairs(sequences(spark, ["ACGT", "ACGT"]))) == []
    forth, back = (rows(diff.diff_pairs(sequences(spark, t))) for t in (["ACGT", "TCGA"], ["TCGA", "ACGT"]))
    assert [(x[2], x[4], x[3]) for x in back] == [x[2:] for x in forth]
    assert rows(diff.diff_pairs(sequences(spark, []))) == []
    plan = spark.createDataFrame([(0, 2)], "first_index long, second_index long")
    assert rows(diff.diff_pairs(sequences(spark, MICRO), "group", plan)) == [x for x in plain_pairs(MICRO) if x[:2] == (0, 2)]
    counts = {tuple(r)[:2]: r.n_diffs for r in diff.diff_counts(diff.diff_pairs(sequences(spark, ["AA", "AA", "AC"])), groups.pair_plan(counted(spark, 3))).collect()}
    assert counts == {(0, 1): 0, (0, 2): 1, (1, 2): 1}


@pytest.mark.parametrize(
    ("first", "seconds", "canonical", "compact"),
    [
        ("ACGT", ["AC", "ACTA"], [(2, "G", [None, "T"]), (3, "T", [None, "A"])], [(2, "G", ["T"]), (3, "T", ["A"])]),
        ("AC", ["ACGT", "AT"], [(1, "C", ["=", "T"])], [(1, "C", ["=", "T"])]),
        ("", ["A"], [], []),
    ],
)
def test_uneven_lengths(spark, first, seconds, canonical, compact):
    seqs = sequences(spark, [first, *seconds])
    for name, expected in (("canonical", canonical), ("compact", compact)):
        found = diff.one_vs_many(seqs, layout=name).filter("first_index = 0").orderBy("Index").select("Index", "first_letter", "letters").collect()
        assert [tuple(r) for r in found] == expected


FASTA = [
    (">1.fasta\nAAAAA\n", "1.fasta", "AAAAA"), (">MT1.1 |desc | x\nACGT\nAC\n", "MT1.1", "ACGTAC"), ("ACGT\nTTTT\n", "Seq", "TTTT"), (">a b|c\r\nAC\r\nGT\r\n", "ab", "ACGT"), (">x\nAC\t \nGT  ", "x", "ACGT"),
    (">p\nAC\n>q\nGT\n", "p", "AC>qGT"), ("", "Seq", ""), (">only", "only", ""), (">>y z\nA\n\nC\n", "yz", "AC"), (">nb\nAC\xa0\nG", "nb", "ACG"), (">tab\tid |d\nA", "tab\tid", "A"), (">cr\rAC\rGT", "cr", "ACGT"), (">fs\nAC\x1c\nG", "fs", "ACG"),
]


def test_fasta_texts(spark):
    df = spark.createDataFrame([(i, t[0]) for i, t in enumerate(FASTA)], "seq_index long, text string")
    assert rows(fasta.parse_fasta(df)) == [(i, t[1], t[2]) for i, t in enumerate(FASTA)]


def test_intervals(spark):
    seq, cases = "ACGTACGT", [("0", "L-1"), ("6", "100"), ("2", "5"), ("5", "2"), ("2", "L-1"), ("20", "L-1"), ("-3", "L-1"), ("-100", "3"), ("-3", "-1"), ("0", "0")]
    df = spark.createDataFrame([(seq, *c) for c in cases], "seq string, a string, b string")
    expected = [seq[int(a) :] if b == "L-1" else seq[int(a) : int(b)] for a, b in cases]
    assert [r[0] for r in df.select(tx.interval(F.col("seq"), F.col("a"), F.col("b"))).collect()] == expected


def test_manifest(spark, tmp_path):
    for i, t in enumerate(MICRO):
        (tmp_path / f"{i + 1}.fasta").write_text(f">{i + 1}.fasta\n{t}\n")
    (tmp_path / "list.txt").write_text("".join(f"{tmp_path}/{i + 1}.fasta, [0,L-1]\n" for i in range(4)))
    lines = manifest.read_manifest_lines(spark, str(tmp_path / "list.txt"))
    files = spark.createDataFrame([(f"{tmp_path}/{i + 1}.fasta",) for i in range(4)], "path string")
    manifest.check_manifest(lines, files)
    assert rows(fasta.read_sequences(spark, manifest.parse_manifest(lines))) == [(i, f"{i + 1}.fasta", t) for i, t in enumerate(MICRO)]
    bad = spark.createDataFrame([(0, ""), (1, "a.fasta,[0,L-1]"), (2, "a.fasta, [0, L-1]"), (3, "a, b.fasta, [0,1]"), (4, "gone.fasta, [0,L-1]"), (5, "  a.fasta, [1,-2] ")], "seq_index long, line string")
    known = spark.createDataFrame([("a.fasta",)], "path string")
    assert rows(manifest.manifest_violations(bad, known)) == [(0, "bad field count"), (1, "bad field count"), (2, "bad field count"), (3, "bad field count"), (4, "file not found")]
    assert rows(manifest.parse_manifest(bad).filter("seq_index = 5")) == [(5, "a.fasta", "1", "-2")]
    single = spark.createDataFrame([(0, "a.fasta, [0,L-1]")], "seq_index long, line string")
    assert [tuple(r) for r in manifest.manifest_violations(single, known).collect()] == [(None, "fewer than 2 sequences")]
    with pytest.raises(FileNotFoundError, match="file not found"):
        manifest.check_manifest(bad.filter("seq_index >= 4"), known)
    twice = spark.createDataFrame([(0, "a.fasta, [0,L-1]"), (1, "a.fasta, [0,L-1]")], "seq_index long, line string")
    manifest.check_manifest(twice, known)


@pytest.mark.parametrize("name", ["f.fasta", "a b.fasta", "50%25 a+b.fasta", "é[1]{x}*.fasta"])
def test_odd_and_relative_paths(spark, tmp_path, name):
    for i, t in enumerate(MICRO):
        (tmp_path / f"{i + 1}{name}").write_text(f">{i + 1}.fasta\n{t}\n")
    (tmp_path / f"0{name}").write_text("")
    here = os.path.relpath(tmp_path, spark._jvm.java.lang.System.getProperty("user.dir"))
    paths = [f"{here}/1{name}", f"{tmp_path}/2{name}", f"file://{tmp_path}/3{name}", f"{here}/1{name}", f"{tmp_path}/0{name}"]
    parsed = spark.createDataFrame([(i, p, "0", "L-1") for i, p in enumerate(paths)], "seq_index long, path string, start_pos string, end_pos string")
    expected = [(0, "1.fasta", MICRO[0]), (1, "2.fasta", MICRO[1]), (2, "3.fasta", MICRO[2]), (3, "1.fasta", MICRO[0]), (4, "Seq", "")]
    assert rows(fasta.read_sequences(spark, parsed)) == expected
    with pytest.raises(FileNotFoundError, match="gone"):
        fasta.read_sequences(spark, parsed.union(spark.createDataFrame([(9, f"{here}/gone", "0", "L-1")], parsed.schema)))


def test_from_manifest_to_written_results(spark, tmp_path):
    here = os.path.relpath(tmp_path, spark._jvm.java.lang.System.getProperty("user.dir"))
    for i, t in enumerate(MICRO):
        (tmp_path / f"{i + 1}.fasta").write_text(f">{i + 1}.fasta |x\n{t}\n")
    (tmp_path / "list.txt").write_text("".join(f"{here}/{i + 1}.fasta, [0,L-1]\n" for i in range(4)))
    path = str(tmp_path / "list.txt")
    written = compare_files(spark, path, "MW", str(tmp_path / "out"), max_s=None)
    assert {r.group_name for r in written.collect()} == {"sequence_0_diff_sequences_1_to_3", "sequence_1_diff_sequences_2_to_3", "sequence_2_diff_sequence_3"}
    (part,) = (tmp_path / "out" / "group_name=sequence_0_diff_sequences_1_to_3").glob("part-*.txt")
    assert part.read_text().splitlines() == ["Index,Seq_1.fasta,Seq_2.fasta,Seq_3.fasta,Seq_4.fasta", "0,A,=,G,=", "1,A,C,=,T", "2,A,G,G,=", "3,A,=,C,="]
    parts = compare_files(spark, path, "DW", str(tmp_path / "parts"), max_s=None)
    assert rows(parts.filter("group_name = 'sequence_0_diff_sequences_1_to_3'").select("Index", "first_letter", "letters")) == [(0, "A", "=,G,="), (1, "A", "C,=,T"), (2, "A", "G,G,="), (3, "A", "=,C,=")]
    assert parts.select("group_name").distinct().count() == 3 and next((tmp_path / "parts" / "group_name=sequence_2_diff_sequence_3").glob("*.csv")).read_text().startswith("Index,first_letter,letters")
    pairs = [(r.first_index, r.Index, r.first_letter, r.letters[0]) for r in compare_files(spark, path).collect()]
    assert sorted(pairs) == sorted((i, k, a, b) for i, _, k, a, b in plain_pairs(MICRO))
    (tmp_path / "list.txt").write_text(f"{here}/1.fasta, [0,L-1]\n{here}/gone.fasta, [0,L-1]\nbad\n")
    with pytest.raises(FileNotFoundError, match="line 1"):
        compare_files(spark, path)


def test_indices_with_gaps(spark):
    seqs = spark.createDataFrame([(i, "x", t) for i, t in zip((0, 5, 9, 70), MICRO)], "seq_index long, seq_id string, seq string")
    found = [(r.first_index, r.chunk, r.Index, r.first_letter, r.letters) for r in diff.one_vs_many(seqs, 2).collect()]
    assert sorted(found, key=str) == sorted((((0, 5, 9, 70)[x[0]], *x[1:]) for x in plain_groups(MICRO, 2)), key=str)


def test_long_uneven_sequences(spark):
    rng = random.Random(5)
    base = [rng.choice("ACGT") for _ in range(3000)]
    texts = []
    for k in range(6):
        letters = list(base)
        for at in rng.sample(range(3000), 12):
            letters[at] = rng.choice("ACGTN")
        texts.append("".join(letters[: 3000 - 400 * (k % 3)]))
    seqs = sequences(spark, texts)
    for found in (diff.one_vs_many(seqs, 2), diff.diff_by_group(seqs, 2)):
        found = [tuple(r) for r in found.select("first_index", "chunk", "Index", "first_letter", "letters").collect()]
        assert sorted(found, key=str) == sorted(plain_groups(texts, 2), key=str)
    assert {tuple(r) for r in diff.count_differences(seqs).collect()} == plain_counts(plain_pairs(texts))
    cut = packed.blocks(seqs, size=diff.BLOCK)
    for strategy in ("block", "consensus"):
        assert rows(diff.diff_pairs(cut, strategy)) == plain_pairs(texts)
    for strategy in STRATEGIES:
        assert rows(diff.diff_pairs(seqs, strategy)) == plain_pairs(texts)


def test_members_are_padded(spark):
    texts = ["ACGTA", "AC", "", "ACTA", "GCGTTT", "A"]
    seqs = sequences(spark, texts)
    plan = groups.exploded(groups.chunk_plan(manifest.sequence_count(seqs), 3))
    members = positions.members_of(plan, seqs)
    sizes = Counter((r.first_index, r.chunk, r.side, r.ordinal) for r in positions.pad_positions(members, ["first_index", "chunk"]).collect())
    longest = {(r.first_index, r.chunk): r.longest for r in positions.longest_sequence(members, ["first_index", "chunk"]).collect()}
    assert all(n == longest[k[:2]] for k, n in sizes.items())


def join_rows(df):
    """The result, and the rows that each join of its plan made."""
    found, waiting, made = df.collect(), [df._jdf.queryExecution().executedPlan()], []
    while waiting:
        node = waiting.pop()
        waiting += [node.children().apply(k) for k in range(node.children().size())]
        if "Join" in node.nodeName():
            made.append(node.metrics().apply("numOutputRows").value())
    return found, made


def test_a_plan_is_followed_and_not_filtered(spark):
    rng = random.Random(8)
    texts = ["".join(rng.choice("ACGT") for _ in range(600)) for _ in range(40)]
    plan = spark.createDataFrame([(i, i + 1) for i in range(39)] + [(0, 1), (7, 3)], "first_index long, second_index long")
    want = sorted([x for x in plain_pairs(texts) if x[1] == x[0] + 1] + [(7, 3, k, b, a) for i, j, k, a, b in plain_pairs(texts) if (i, j) == (3, 7)])
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        seqs = sequences(spark, texts)
        found, made = join_rows(diff.diff_pairs(seqs, plan=plan))
        assert sorted(map(tuple, found)) == want and len(made) == 2 and max(made) <= 40 * 3
        found, made = join_rows(diff.count_differences(seqs, plan))
        assert {tuple(r) for r in found} == plain_counts(want) and max(made) <= 40 * 10
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)


def test_counts_open_no_letters(spark):
    plan = diff.count_differences(sequences(spark, MICRO))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate") == plan.count("regexp_extract_all")  # the cut into blocks alone


def test_words_of_sixty_four_letters(spark):
    rng = random.Random(9)
    texts = ["".join(rng.choice(letters) for _ in range(n)) for letters in ("AB", "AB", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0é🙂") for n in (63, 64, 65, 128, 129)]
    assert {tuple(r) for r in diff.count_differences(sequences(spark, texts)).collect()} == plain_counts(plain_pairs(texts))
    assert diff.count_differences(sequences(spark, [])).count() == 0 and diff.count_differences(sequences(spark, ["", "AAA", "AAA"])).count() == 0
    cut = packed.blocks(sequences(spark, texts), size=packed.WORD)
    masks = {(r.block, tuple(r.at)) for r in packed.varying_masks(packed.planes(cut, packed.alphabet(cut))).select("block", packed.places(F.col("mask")).alias("at")).collect()}
    want = {b: tuple(k for k in range(64) if len({t[64 * b + k] for t in texts if len(t) > 64 * b + k}) > 1) for b in range(3)}
    assert masks == {(b, at) for b, at in want.items() if at}


def test_few_deviations_are_kept(spark):
    rng = random.Random(10)
    base = [rng.choice("ACGT") for _ in range(900)]
    texts = []
    for k in range(9):
        own = list(base)
        for at in rng.sample(range(900), 4):
            own[at] = "N"
        texts.append("".join(own[: 900 - 50 * (k % 2)]))
    rows_kept = diff.deviations(sequences(spark, texts)).collect()
    assert len(rows_kept) <= 36 and {r.letter for r in rows_kept} == {"N"}


def test_no_row_carries_a_whole_sequences_letters(spark):
    seqs = sequences(spark, MICRO)
    members = positions.members_of(groups.exploded(groups.chunk_plan(counted(spark, 4), 3)), seqs)
    for df in (positions.pad_positions(members, ["first_index", "chunk"]), diff.diff_pairs(seqs, "block")):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert "Generate" in plan and "_letters" not in plan
        assert not any("explode(sequence(0" in line and "seq#" in line.partition("explode")[0] for line in plan.splitlines())


def test_the_shared_folder_must_be_named_on_a_cluster(spark):
    class Cluster:
        conf = type("C", (), {"get": staticmethod(lambda name, default=None: default)})()
        sparkContext = type("S", (), {"master": "spark://host:7077"})()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared.shared_dir(Cluster())
    table = shared.written(counted(spark, 3), "x")
    path = table.inputFiles()[0].removeprefix("file://")
    assert os.path.exists(path)
    shared.dropped(table)
    assert not os.path.exists(path)


def test_plans(spark):
    checks = {(10, 3): (19, 18), (10, 4): (15, 15), (10, 5): (13, 13), (5, 2): (7, 6), (4, 3): (3, 3), (4, 2): (4, 4), (4, 9): (0, 3)}
    for (n, s), (estimate, actual) in checks.items():
        r = groups.plan_statistics(counted(spark, n), [s]).first()
        assert (r.estimated, r.actual, r.absolute_error) == (estimate, actual, abs(estimate - actual))
        assert (r.percent_error is None) == (estimate == 0)
        assert groups.chunk_plan(counted(spark, n), s).count() == actual
    assert rows(groups.pair_plan(counted(spark, 3))) == [(0, 1), (0, 2), (1, 2)]
    assert rows(groups.pair_plan(counted(spark, 1))) == [] == rows(groups.chunk_plan(counted(spark, 0)))
    assert rows(groups.chunk_plan(counted(spark, 4), 2)) == [(0, 0, [1, 2]), (0, 1, [3]), (1, 0, [2, 3]), (2, 0, [3])]
    names = rows(layout.named_groups(groups.chunk_plan(counted(spark, 4), 2)))
    assert [x[2] for x in names] == ["sequence_0_diff_sequences_1_to_2", "sequence_0_diff_sequence_3", "sequence_1_diff_sequences_2_to_3", "sequence_2_diff_sequence_3"]
    with pytest.raises(ValueError):
        groups.chunk_plan(counted(spark, 3), 0)


def test_labels_wide_and_lines(spark):
    seqs = spark.createDataFrame([(0, "Seq", "AC"), (1, "Seq", "AG"), (2, "x.1", "TC")], "seq_index long, seq_id string, seq string")
    members = positions.members_of(groups.exploded(groups.chunk_plan(counted(spark, 3))), seqs).filter("first_index = 0")
    labels = rows(positions.label_members(members).select("side", "ordinal", "label"))
    assert labels == [(0, 0, "Seq_1"), (1, 0, "Seq_1"), (1, 1, "Seq_x.1")]
    wide = layout.wide(positions.label_members(positions.pad_positions(members, ["first_index", "chunk"])).select("seq_index", "label", "Index", "letter"))
    assert wide.columns == ["Index", "Seq_1", "Seq_1_1", "Seq_x.1"]
    assert rows(wide) == [(0, "A", "A", "T"), (1, "C", "G", "C")]
    one = diff.one_vs_many(seqs)
    assert [r.line for r in layout.as_lines(one).filter("first_index = 0").orderBy("Index").collect()] == ["0,A,=,T", "1,C,G,="]
    assert layout.wide_rows(one.filter("first_index = 0"), "a", ["b", "c"]).columns == ["Index", "a", "b", "c"]


def test_labels_of_a_wide_table_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(layout, "MOST_COLUMNS", 3)
    of = lambda n: spark.range(n).selectExpr("id seq_index", "'s' || id label", "0L Index", "'A' letter")
    assert layout.wide(of(3)).columns == ["Index", "s0", "s1", "s2"]
    with pytest.raises(ValueError, match="too many"):
        layout.wide(of(4))
    for n in (0, 4):
        with pytest.raises(ValueError):
            layout.wide_groups(diff.one_vs_many(sequences(spark, MICRO)), n)


@pytest.mark.parametrize("max_s", [1, 2, 3, 5])
def test_wide_groups(spark, max_s):
    seqs = sequences(spark, MICRO)
    found = layout.wide_groups(diff.one_vs_many(seqs, max_s, sign=False), max_s)
    assert found.columns == ["first_index", "chunk", "Index", "first", *(f"second_{k}" for k in range(max_s))]
    want = []
    for i, x in enumerate(MICRO):
        later = MICRO[i + 1 :]
        for c in range(0, len(later), max_s):
            for k, a in enumerate(x):
                seconds = [t[k] if k < len(t) else None for t in later[c : c + max_s]]
                if any(b not in (None, a) for b in seconds):
                    want.append((i, c // max_s, k, a, *seconds, *[None] * (max_s - len(seconds))))
    assert sorted(map(repr, rows(found))) == sorted(map(repr, want))


def test_wide_group(spark):
    seqs = spark.createDataFrame([(0, "Seq", "ACA"), (1, "Seq", "AGAT"), (2, "x.1", "TC"), (3, "X.1", "ACC")], "seq_index long, seq_id string, seq string")
    members = positions.label_members(positions.members_of(groups.exploded(groups.chunk_plan(counted(spark, 4))), seqs))
    one = diff.one_vs_many(seqs)
    whole = layout.wide_group(one, members, 0)
    assert whole.columns == ["Index", "Seq_1", "Seq_1_1", "Seq_x.1", "Seq_X.1_3"]
    assert sorted(map(tuple, whole.collect())) == [(0, "A", "=", "T", "="), (1, "C", "G", "=", "="), (2, "A", "=", None, "C")]
    assert layout.wide_group(one, members, 2).columns == ["Index", "Seq_x.1", "Seq_X.1_3"]
    with pytest.raises(ValueError, match="not there"):
        layout.wide_group(one, members, 3)


@pytest.mark.parametrize("phase", ["None", "SC", "DW", "MW"])
def test_compare_files_wide(spark, tmp_path, phase):
    for i, text in enumerate(MICRO):
        (tmp_path / f"{i}.fa").write_text(f">s{i} |\n{text}\n")
    (tmp_path / "list").write_text("\n".join(f"{tmp_path}/{i}.fa, [0,L-1]" for i in range(len(MICRO))))
    plain = layout.wide_groups(diff.one_vs_many(sequences(spark, MICRO), 2), 2)
    found = compare_files(spark, str(tmp_path / "list"), phase, str(tmp_path / "out"), max_s=2, wide=True)
    if phase in ("None", "SC"):
        assert sorted(map(repr, rows(found))) == sorted(map(repr, rows(plain)))
        return
    named = layout.named_groups(groups.chunk_plan(counted(spark, len(MICRO)), 2))
    want = plain.join(named, ["first_index", "chunk"]).select(*found.columns)
    assert sorted(map(repr, rows(found))) == sorted(map(repr, rows(want)))
    folders = [f for f in (tmp_path / "out").iterdir() if f.is_dir()]
    assert len(folders) == named.count()
    if phase == "MW":
        assert all(len(list(f.glob("part-*.csv"))) == 1 for f in folders)
    with pytest.raises(ValueError, match="max_s"):
        compare_files(spark, str(tmp_path / "list"), phase, max_s=None, wide=True)


def test_sinks(spark, tmp_path):
    pairs = diff.diff_pairs(sequences(spark, [*MICRO, ' ",\n', "      "]))
    for name, write in (("d", sinks.write_distributed), ("m", sinks.write_merged)):
        path = str(tmp_path / name)
        write(pairs, path)
        assert rows(sinks.read_csv(spark, path, pairs.schema)) == rows(pairs)
    assert len(list((tmp_path / "m").glob("part-*.csv"))) == 1
    sinks.write_merged(pairs, str(tmp_path / "m"))
    assert sinks.read_csv(spark, str(tmp_path / "m"), pairs.schema).count() == 2 * pairs.count()
    lines = layout.as_lines(diff.one_vs_many(sequences(spark, MICRO)))
    sinks.write_lines(lines, str(tmp_path / "l"))
    with pytest.raises(Exception, match="exist"):
        sinks.write_lines(lines, str(tmp_path / "l"))
    assert [r.Index for r in sinks.collect_phase(pairs, "SC").collect()] == sorted(r.Index for r in pairs.collect())
    with pytest.raises(ValueError):
        sinks.collect_phase(pairs, "XX")


def test_merged_files_are_in_order_and_bounded(spark, tmp_path):
    hot = spark.range(3000).selectExpr("id first_index", "id + 1 second_index", "if(id % 3 = 0, id, 7L) Index", "'A' first_letter", "'C' second_letter")
    sinks.write_merged(hot, str(tmp_path / "m"), file_rows=500)
    files = sorted((tmp_path / "m").glob("part-*.csv"))
    assert 6 >= len(files) >= 5
    parts = [[tuple(map(int, line.split(",")[:3])) for line in f.read_text().splitlines()[1:]] for f in files]
    assert max(map(len, parts)) <= 1000  # position 7 has two thirds of the rows
    told = [(k, i, j) for part in parts for i, j, k in part]
    assert told == sorted(told) and len(told) == 3000
    nothing = hot.filter("first_index < 0")
    sinks.write_merged(nothing, str(tmp_path / "e"))
    assert len(list((tmp_path / "e").glob("part-*.csv"))) == 1 and sinks.read_csv(spark, str(tmp_path / "e"), hot.schema).count() == 0
    arrays = diff.one_vs_many(sequences(spark, MICRO))
    sinks.write_merged(sinks.flat(arrays), str(tmp_path / "f"))
    assert sinks.read_csv(spark, str(tmp_path / "f"), sinks.flat(arrays).schema).count() == arrays.count()


def test_arriving_sequences(spark, tmp_path):
    known = sequences(spark, MICRO[:2])
    box, out, progress = (str(tmp_path / x) for x in ("in", "out", "progress"))
    for turn, new in enumerate((MICRO[2], MICRO[3])):
        spark.createDataFrame([(10 + turn, "n", new)], known.schema).write.mode("append").parquet(box)
        found = incremental.diff_against(spark.readStream.schema(known.schema).parquet(box), known)
        incremental.write_available(found, out, progress)
    expected = sorted((10 + j, i, k, y, x) for j, b in enumerate(MICRO[2:]) for i, a in enumerate(MICRO[:2]) for k, (x, y) in enumerate(zip(a, b)) if x != y)
    assert rows(spark.read.parquet(out)) == expected


def test_no_outer_join_is_left(spark):
    plan = diff.diff_pairs_outer_form(sequences(spark, MICRO))._jdf.queryExecution().optimizedPlan().toString()
    assert "FullOuter" not in plan and "Inner" in plan
