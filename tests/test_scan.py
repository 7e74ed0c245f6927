"""Scans as plans: strategies agree, pieces agree, limits, strands, formats, merging, sources."""

import gzip
import json
import random
import time

import duckdb
import numpy as np
import pytest

from seqmotif import queries
from seqmotif.operators import features, merge
from seqmotif.operators.kernel import Matcher, loose
from seqmotif.operators.scan import MissLimit, check_misses, scan, strategy
from seqmotif.pattern import PatternError, parse
from seqmotif.pattern.parser import lengths
from seqmotif.pattern.units import IUPAC, base_mask, reverse_complement
from seqmotif.plans import vector
from seqmotif.sources import catalog, fasta, matrix

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def seqs(spark):
    rng = random.Random(1)
    rows = [(i, f"s{i}", "".join(rng.choice("ACGTacgt") for _ in range(rng.choice([0, 3, 40, 300])))) for i in range(16)]
    return spark.createDataFrame([*rows, (99, "null", None)], "seq_ord long, seq_id string, seq string").cache()


@pytest.mark.parametrize("pattern", ["RYRYRY", "TAT[1,0,0]", "p1=3...5 2...6 p1", "p1=4...4 3...8 ~p1", "r1={at,ta,gc,cg,gt,tg} p1=4...4 3...6 r1~p1", "^ 2...9 TA", "A p2=4...4 20...300 ~p2 T", "p1=2...4 CA p2=1...3 length(p1+p2) < 5 p1", "TATCA[1,1,1] 0...3 G", "p1=4...4 20...90 ~p1[1,0,0] A", "A ( CA | G ) 2...4 T"])
def test_strategies_agree(seqs, pattern):
    assert strategy(parse(pattern), plain=True) != "kernel"
    found = sorted(map(str, scan(seqs, pattern, engine="kernel", both_strands=True).collect()))
    assert found == sorted(map(str, scan(seqs, pattern, engine="vector", both_strands=True).collect()))
    if "[" not in pattern and "p" not in pattern and "(" not in pattern:
        assert found == sorted(map(str, scan(seqs, pattern, engine="regex", plain=True, both_strands=True).collect()))


def letters(texts, pattern):
    raw = np.frombuffer("".join(texts).encode("latin-1"), np.uint8)
    return vector.Letters(raw, np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64), pattern.dna, lengths(pattern.units)[1] + 50)


def spelled(data, hits):
    """(record, start, end, entries) as the matcher gives them."""
    for start, end, route, gap in zip(*(x.tolist() for x in (hits.start, hits.end, hits.route, hits.gap))):
        record = int(np.searchsorted(data.bounds, start, side="right")) - 1
        at, entries = start - int(data.bounds[record]), []
        first = at
        for unit, n in hits.routes[route]:
            entries.append((unit, at, at := at + (gap if n is None else n)))
        assert at - first == end - start
        yield record, first, at, tuple(entries)


def random_pattern(rng):
    err = lambda: rng.choice(["", "", "[1,0,0]", "[2,0,0]", "[0,1,0]", "[0,0,1]", "[1,1,1]"])
    names, units = [], []
    for k in range(rng.randint(1, 5)):
        kind, a = rng.random(), rng.randint(0 if k else 1, 6)
        if kind < 0.3:
            unit = "".join(rng.choice("ACGTRYN") for _ in range(rng.randint(1, 5))) + err()
        elif kind < 0.6 or not k:
            unit = f"{a}...{a + rng.choice([0, 1, 3, 8, 20])}"
        elif names and kind < 0.9:
            unit = rng.choice(["p{}", "~p{}", "<p{}", "r1~p{}"]).format(rng.choice(names)) + err()
        elif names and kind < 0.93:
            unit = f"length(p{names[0]}) < {rng.randint(1, 5)}"
        else:
            unit = rng.choice(["( AC | 1...2 G )", "{(9,-20,30,5),(50,0,50,0),(1,2,3,60)} > 40"])
        if not unit.startswith(("length", "(")) and rng.random() < 0.5:
            names.append(len(names) + 1)
            unit = f"p{names[-1]}={unit}"
        units.append(unit)
    return parse("r1={at,ta,gc,cg,gt,tg} " + " ".join(units))


def test_arrays_agree_with_the_matcher_on_random_patterns(monkeypatch):
    rng, tried, hits = random.Random(11), 0, 0
    while tried < 400:
        try:
            pattern = random_pattern(rng)
        except PatternError:
            continue
        monkeypatch.setattr(vector, "WIDE", rng.choice([4, 8, 48]))
        overlaps, strict = rng.random() < 0.2, rng.random() < 0.4
        if not vector.supported(pattern) or overlaps and any(map(vector.wide, pattern.flat)):
            continue
        tried += 1
        abc = rng.choice(["ACGT", "ACGTacgtu", "ACGTN", "AC", "ACGTRNX-"])
        texts = ["".join(rng.choice(abc) for _ in range(rng.choice([0, 1, 5, 30, 60]))) for _ in range(5)]
        data, matcher = letters(texts, pattern), Matcher(pattern, strict)
        found = vector.Search(pattern, data, strict, overlaps).hits()
        found = found if overlaps else found.take(vector.chain(found))
        expected = [(k, a, b, e) for k, t in enumerate(texts) for a, b, e in matcher.hits(t, overlaps)]
        assert list(spelled(data, found)) == expected, (pattern.text, texts, strict, overlaps)
        hits += len(expected)
    assert hits > 5000


def test_arrays_agree_with_the_matcher_on_all_lengths(monkeypatch):
    """With ``align`` complements have every length; strategy() left those patterns to the matcher, start by start."""
    assert strategy(parse("p1=6...6 3...5 ~p1[0,1,1] A"), align=True) == "vector"
    rng, tried, hits = random.Random(12), 0, 0
    monkeypatch.setattr(vector, "ROWS", 70)
    while tried < 250:
        err = f"[{rng.randint(0, 2)},{rng.randint(0, 2)},{rng.randint(0, 2)}]"
        size, gap = rng.randint(1, 6), rng.randint(0, 4)
        text = f"{rng.choice(['', 'A ', 'RY[0,1,0] '])}p1={size}...{size + rng.randint(0, 1)} {gap}...{gap + rng.randint(0, 3)} {rng.choice(['~p1', 'r1~p1'])}{err} {rng.choice(['A', 'p1', '~p1[0,1,1] C', '$', '', '0...2 CA[1,0,1]'])}"
        pattern = parse("r1={at,ta,gc,cg,gt,tg} " + text)
        overlaps, strict = rng.random() < 0.4, rng.random() < 0.4
        if not vector.supported(pattern, True):
            continue
        tried += 1
        abc = rng.choice(["ACGT", "ACGTacgtu", "ACGTN", "AT"])
        texts = ["".join(rng.choice(abc) for _ in range(rng.choice([0, 1, 5, 30, 60]))) for _ in range(5)]
        data, matcher = letters(texts, pattern), Matcher(pattern, strict, True)
        found = vector.Search(pattern, data, strict, overlaps, True).hits()
        found = found if overlaps else found.take(vector.chain(found))
        expected = [(k, a, b, e) for k, t in enumerate(texts) for a, b, e in matcher.hits(t, overlaps)]
        assert list(spelled(data, found)) == expected, (pattern.text, texts, strict, overlaps)
        hits += len(expected)
    assert hits > 5000


def test_alignments_of_many_rows_are_those_of_one_and_cheap():
    rng = random.Random(5)
    for _ in range(300):
        n, budget = rng.randint(1, 7), tuple(rng.randint(0, 2) for _ in range(3))
        texts = ["".join(rng.choice("ACN") for _ in range(rng.choice([0, 1, 3, 6, 12]))) for _ in range(30)]
        words = ["".join(rng.choice("ACM") for _ in range(n)) for _ in texts]
        data = letters([*texts, "ACGTACGTACGTAC"], parse("p1=6...6 p1"))
        columns = [np.array([base_mask(w[k]) for w in words], np.uint8) for k in range(n)]
        lanes = vector.Lanes(data, columns, data.bounds[:-2], np.diff(data.bounds)[:-1], budget)
        expected = []
        for word, text in zip(words, texts):
            ok = lambda p, q: text[q] in IUPAC[word[p]]  # noqa: B023, E731
            expected.append(loose(ok, n, 0, len(text), budget))
        assert [None if x < 0 else x for x in lanes.first().tolist()] == expected
    pattern = parse("p1=6...6 3...5 ~p1[1,1,1]")
    data = letters(["".join(rng.choice("ACGT") for _ in range(500)) for _ in range(400)], pattern)
    began = time.process_time()
    assert len(vector.Search(pattern, data).hits().start)
    assert time.process_time() - began < 2  # 5 s with a row of five numbers for each state


@pytest.mark.parametrize("pattern", ["p1=8...8 p2=5...7 50...30000 ~p2 p1", "p2=6...6 50...2000 ~p2[1,0,0] TA", "p1=12...12 100...3000 p1"])
def test_wide_gaps_on_low_complexity(pattern):
    rng = random.Random(4)
    texts = ["A" * 3000 + "T" * 3000, "AT" * 2000, "A" * 900 + "".join(rng.choice("AT") for _ in range(1500)) + "T" * 900, "N" * 500 + "ACGT" * 400]
    parsed = parse(pattern)
    data = letters(texts, parsed)
    began = time.time()
    found = vector.Search(parsed, data).hits()
    assert time.time() - began < 20 and len(found.start)
    for record, _, _, entries in list(spelled(data, found))[::97]:
        piece = {u: texts[record][a:b] for u, a, b in entries}
        for u in (x for x in parsed.flat if x.ref is not None):
            other = next(x for x in parsed.flat if x.name == u.ref).index
            if "N" not in piece[other]:
                want = reverse_complement(piece[other]) if u.kind == "complement" else piece[other]
                assert sum(x != y for x, y in zip(piece[u.index], want)) <= u.err[0] and len(piece[u.index]) == len(want)


@pytest.mark.parametrize("size", [7, 50, 1000])
@pytest.mark.parametrize("pattern", ["p1=4...4 3...8 ~p1", "RYRR", "p1=3...3 20...90 p1[1,0,0]", "4...6"])
def test_pieces_do_not_change_hits(seqs, size, pattern):
    whole = sorted(map(str, scan(seqs, pattern, engine="kernel", both_strands=True).collect()))
    assert whole == sorted(map(str, scan(seqs, pattern, both_strands=True, piece=size).collect()))


def test_partitions_do_not_change_hits(seqs):
    patterns = ["p1=4...6 2...8 ~p1", "RYRR", "TATC[1,1,1]"]
    one = sorted(map(str, scan(seqs.coalesce(1), patterns, both_strands=True).collect()))
    assert all(one == sorted(map(str, scan(seqs.repartition(n), patterns, both_strands=True).collect())) for n in (3, 11))


def test_wide_gaps_are_looked_up_among_partners_only(monkeypatch):
    """Records that share letters with each other but not with themselves leave no start to look up; those that do lose none."""
    rng = random.Random(6)
    word = lambda n: "".join(rng.choice("ACGT") for _ in range(n))
    asked, lookup = [], vector.Search.lookup
    monkeypatch.setattr(vector.Search, "lookup", lambda self, places, *more: (asked.append(len(places)), lookup(self, places, *more))[1])
    shared = word(150)
    plain = [shared[:90], *(word(9) + shared for _ in range(6))]
    for text in ("p1=8...8 p2=12...12 50...3000 ~p2 p1", "p1=9...11 p2=5...7 50...3000 ~p2 p1", "p1=8...8 50...900 p1 ~p1", "p1=6...6 p2=9...9 50...900 ~p2[1,0,0] r1~p1"):
        pattern = parse("r1={at,ta,gc,cg,gt,tg} " + text)
        site = "".join(rng.choice("ACGT") for _ in range(11))
        arm = word(12)
        some = [site + arm + word(60) + reverse_complement(arm) + site + word(9), word(8) + "N" + site[:8] + word(70) + site[:8] + reverse_complement(site[:8])]
        for texts in (plain, [*plain, *some], [some[1], *plain, "ACGN" + shared, "AT" * 200]):
            asked.clear()
            data = letters(texts, pattern)
            found = vector.Search(pattern, data).hits()
            expected = [(k, a, b, e) for k, t in enumerate(texts) for a, b, e in Matcher(pattern).hits(t)]
            assert list(spelled(data, found.take(vector.chain(found)))) == expected
            assert texts is not plain or "[1" in text or max(asked, default=0) < data.n / 4


def planted(pattern, rng):
    """Letters that the pattern finds, with the least gap and each capture at its greatest length."""
    word = lambda n: "".join(rng.choice("ACGT") for _ in range(n))
    made, out = {}, []
    for u in parse(pattern).units:
        if u.kind == "word":
            text = "".join(rng.choice(IUPAC[c]) for c in u.letters)
        elif u.kind == "range":
            text = word(u.high if u.name is not None else u.low)
        else:
            text = made[u.ref] if u.kind == "repeat" else reverse_complement(made[u.ref])
            for k in range(u.err[0]):
                text = text[:k] + {"A": "C", "C": "G", "G": "T", "T": "A"}[text[k]] + text[k + 1 :]
        if u.name is not None:
            made[u.name] = text
        out.append(text)
    return "".join(out)


def test_catalog_scan_has_every_pattern(spark, tmp_path):
    rng = random.Random(8)
    patterns = [r[2] for r in catalog.ELEMENTS]
    small = [p for p in patterns if max(u.low for u in parse(p).flat) < 500]
    docs = [(k, planted(p, rng)) for k, p in enumerate(small)] + [(90, reverse_complement(planted(small[5], rng))), (91, None), (92, "ACGT")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    expected = {}
    for order, p in enumerate(patterns):
        matcher = Matcher(parse(p))
        for _, s in docs:
            for strand in "+-":
                t = s or ""
                for a, b, _ in matcher.hits(t if strand == "+" else reverse_complement(t)):
                    x, y = (a + 1, b) if strand == "+" else (len(t) - b + 1, len(t) - a)
                    n, least, most = expected.get((order, strand), (0, x, y))
                    expected[order, strand] = (n + 1, min(least, x), max(most, y))
    got = {(r.pat_ord, r.strand): (r.n, r.least, r.most) for r in queries.catalog_scan(spark, str(tmp_path)).collect()}
    assert got == expected and {patterns.index(p) for p in small} <= {order for order, _ in got}


def test_limits_and_ids(spark):
    df = spark.createDataFrame([(0, "x", "AAAAA"), (1, "y", "A"), (2, "z", "CC")], "seq_ord long, seq_id string, seq string")
    assert [(r.seq_id, r.start) for r in scan(df, "A", max_hits=2).collect()] == [("x", 1), ("x", 2)]
    assert scan(df, "A", ignore_ids=["x"]).count() == 1
    with pytest.raises(MissLimit):
        check_misses(df, scan(df, "GGGG"), 2)


ELEMENT = """%@element CACTA_TIR_transposon Name=DTC Classification=TIR/DTC
p1=3...3               %@ target_site_duplication
CACTA p2=7...7         %@ five_prime_terminal_inverted_repeat
10...50
~p2 TAGTG              %@ three_prime_terminal_inverted_repeat
p1                     %@ target_site_duplication
"""
RECORD = "CCTTGGAACCTTGGAACCTTGATCACTAACGTTGCAAAAATTTTTCCCCCGGGGGAAAAATTTTTGCAACGTTAGTGGATCCTTGGAACCTTGGA"


def test_formats(spark):
    df = spark.createDataFrame([(0, "chr1", RECORD)], "seq_ord long, seq_id string, seq string")
    pattern = parse(ELEMENT)
    found = features.dedup_strands(scan(df, pattern, both_strands=True))
    named = features.named(found, ["X"], first=7)
    assert [r.text for r in features.bed6(named).collect()] == ["chr1\t20\t80\tX7\t0\t."]
    single = features.named(scan(df, pattern), ["DTC"])
    assert features.rendered(single, [pattern], "bed12").first().text == "chr1\t20\t80\tDTC1\t0\t+\t23\t77\t0\t4\t3,12,12,3,\t0,3,45,57,"
    lines = features.rendered(single, [pattern], "gff3").first().text.split("\n")
    assert [tuple(x.split("\t")[2:5]) for x in lines[:-1]] == [("repeat_region", "21", "80"), ("target_site_duplication", "21", "23"), ("CACTA_TIR_transposon", "24", "77"), ("five_prime_terminal_inverted_repeat", "24", "35"), ("three_prime_terminal_inverted_repeat", "66", "77"), ("target_site_duplication", "78", "80")]
    assert lines[2].split("\t")[8] == "ID=DTC1.te;Parent=DTC1;Name=DTC1;Classification=TIR/DTC;Method=structural;Sequence_ontology=SO:0002285;TSD=GAT_GAT;TIR=CACTAACGTTGC_GCAACGTTAGTG"


def test_merge(spark, tmp_path):
    def feature(seq, a, b, name, extra=""):
        return f"{seq}\tx\trepeat_region\t{a}\t{b}\t.\t+\t.\tID={name};Name={name}{extra}\n{seq}\tx\tTE\t{a + 1}\t{b - 1}\t.\t+\t.\tID={name}.te;Parent={name};Name={name}\n###\n"

    (tmp_path / "a.gff3").write_text("##gff-version 3\n" + feature("chr10", 10, 50, "AA1", ";K=v") + feature("chr2", 1, 100, "AA2"))
    (tmp_path / "b.gff3").write_text("##gff-version 3\n" + feature("chr10", 10, 50, "BB7") + feature("chr2", 6, 105, "BB8"))
    paths = [str(tmp_path / f) for f in ("a.gff3", "b.gff3")]
    out = [r.text for r in merge.merge_files(spark, paths, share=0.9).orderBy("out_ord").collect()]
    assert len(out) == 2 and out[0].startswith("chr2") and "Merged=b.gff3:BB8" in out[0]
    assert out[1].split("\n")[0].endswith("ID=AA2;Name=AA2;K=v;Merged=b.gff3:BB7")
    assert len(merge.merge_files(spark, paths).collect()) == 3


def gff(*pairs):
    return "".join(f"c1\tx\tt\t{k + 1}\t{k + 50}\t.\t+\t.\t{p}\n" for k, p in enumerate(pairs))


def test_element_roots(spark, tmp_path):
    for name, text in {"deep": gff("ID=a", *(f"ID=x{k};Parent={'a' if not k else f'x{k - 1}'}" for k in range(9))), "two": gff("ID=a;Parent=b", "ID=b;Parent=a"), "three": gff("ID=a;Parent=b", "ID=b;Parent=c", "ID=c;Parent=a", "ID=d"), "self": gff("ID=a;Parent=a"), "gone": gff("ID=a;Parent=z"), "cross": gff("ID=a", "ID=b", "ID=c;Parent=a,b"), "twice": gff("ID=a", "ID=b", "ID=c;Parent=a", "ID=c;Parent=b")}.items():
        (tmp_path / f"{name}.gff3").write_text(text)
    read = lambda name: fasta.read_gff3(spark, str(tmp_path / f"{name}.gff3"))
    (deep,) = merge.elements(read("deep")).collect()
    assert len(deep.lines) == 10 and deep.name == "a"
    for name in ("two", "three", "self"):
        with pytest.raises(merge.MergeError):
            merge.roots(read(name))
    for name in ("gone", "cross", "twice"):
        with pytest.raises(Exception, match="parent|parents"):
            merge.roots(read(name)).collect()


def test_merge_overlap_against_brute_force(spark):
    rng = random.Random(3)
    rows = [(f, k, rng.choice(["c1", "c2"]), a := rng.randint(1, 300), a + rng.randint(5, 60), f"n{f}{k}") for f in (0, 1) for k in range(150)]
    kept, gone = [], {}
    for r in sorted(rows):
        near = [k for k in kept if k[2] == r[2] and merge.overlapping(k[3:5], r[3:5], 0.6)]
        gone.setdefault(near[0][5], []).append(f"{r[0]}:{r[5]}") if near else kept.append(r)
    got = merge.merge(spark.createDataFrame(rows, "file_ord int, elem_ord long, seqid string, start long, end long, name string"), share=0.6).collect()
    assert {r.old_name: r.merged for r in got} == {k[5]: ",".join(gone.get(k[5], [])) for k in kept}
    assert sorted(r.out_ord for r in got) == list(range(1, len(kept) + 1))


def test_escapes(spark):
    df = spark.createDataFrame([("a\tb%;=&,é", 1), ("plain", 2)], "t string, k int")
    got = [tuple(r) for r in df.orderBy("k").select(features.escaped(df.t, features.ATTRIBUTE), features.escaped(df.t, features.SEQID), features.unescaped(features.escaped(df.t, features.ATTRIBUTE)), features.unescaped(df.t)).collect()]
    assert got == [("a%09b%25%3B%3D%26%2Cé", "a%09b%25%3B%3D%26%2C%C3%A9", "a\tb%;=&,é", "a\tb%;=&,é"), ("plain",) * 4]


def test_outputs(spark, tmp_path):
    df = spark.createDataFrame([(0, "chr 1é", RECORD), (1, "b", "ACGT")], "seq_ord long, seq_id string, seq string")
    pattern = parse(ELEMENT)
    hits = features.named(scan(df, pattern, both_strands=True), ["D"])
    features.write_hits(hits, [pattern], str(tmp_path / "g"), "gff3")
    lines = [r.value for r in spark.read.text(str(tmp_path / "g")).collect()]
    assert lines[:2] == ["##gff-version 3", "##sequence-region chr%201%C3%A9 1 95"] and lines[2].startswith("chr%201%C3%A9\tseqmotif\trepeat_region\t21\t80") and len(lines) == 16
    assert [x.split("\t")[6] for x in lines[9:15]] == ["-"] * 6 and "TSD=GAT_GAT;TIR=CACTAACGTTGC_GCAACGTTAGTG" in lines[11]
    rows = [r.text for r in features.rendered(hits, [pattern], "jsonl").collect()]
    assert all(r.isascii() for r in rows) and [json.loads(r)["seq"] for r in rows] == ["chr 1é"] * 2
    units = json.loads(rows[0])["units"]
    assert [u["text"] for u in units] == [RECORD[u["start"] - 1 : u["end"]] for u in units] and [u.get("label") for u in units][3] is None
    with pytest.raises(ValueError):
        features.write_hits(scan(df, pattern), [pattern], str(tmp_path / "h"), "bed6")


def test_fasta(spark, tmp_path):
    data = b"junk\n>a first\nAC GT\r\nNN>b\nTT\n> \n c\nGG"
    assert list(fasta.parse_fasta(data)) == [("a", "ACGTNN"), ("b", "TT"), ("c", "GG")]
    (tmp_path / "x.fa").write_bytes(gzip.compress(data[:15]) + gzip.compress(data[15:]))
    assert [tuple(r) for r in fasta.read_fasta(spark, str(tmp_path / "x.fa")).orderBy("seq_ord").collect()] == [(0, "a", "ACGTNN"), (1, "b", "TT"), (2, "c", "GG")]
    with pytest.raises(ValueError, match="gzip input"):
        fasta.inflate(gzip.compress(data)[:-9])


def test_matrix():
    (_, name, columns), = matrix.parse_matrices(">M1 x\nA [ 4 0 ]\nC [0 4]\nG [0 0]\nT [0 0]")
    weights = matrix.integer_weights(columns)
    distribution = matrix.score_distribution(weights)
    assert name == "x" and abs(sum(distribution.values()) - 1) < 1e-9
    t = matrix.cutoff(distribution, 1 / 16)
    assert sum(p for s, p in distribution.items() if s > t) <= 1 / 16 < sum(p for s, p in distribution.items() if s >= t)


@pytest.mark.parametrize("name", ["word_exact", "gap", "named_repeat", "hairpin_mismatch", "lax_n", "overlapping_hits", "merge_exact", "jsonl_units", "stream_scan"])
def test_oracle(spark, name):
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = queries.QUERIES[name](spark, SF)
    result = con.execute(queries.SQL[name])
    columns = [c[0] for c in result.description]
    assert sorted(columns) == sorted(df.columns)
    assert sorted(map(repr, result.fetchall())) == sorted(repr(tuple(r[c] for c in columns)) for r in df.collect())


def agrees(spark, name, sf):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{sf}/documents.parquet{'/*.parquet' if sf != SF else ''}')")
    df = queries.QUERIES[name](spark, sf)
    result = con.execute(queries.SQL[name])
    columns = [c[0] for c in result.description]
    rows = [tuple(r[c] for c in columns) for r in df.collect()]
    assert sorted(columns) == sorted(df.columns) and sorted(map(repr, result.fetchall())) == sorted(map(repr, rows))
    return rows


def test_multi_pattern_keeps_chained_hits_of_each(spark, tmp_path):
    docs = [(1, "GCAGCAGCAGCTATAA"), (2, "ACGGTACGGTA"), (3, None), (4, "")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    assert sorted(agrees(spark, "multi_pattern_chain", str(tmp_path))) == [(1, 0, 12, 16), (1, 1, 1, 5), (1, 1, 7, 11), (2, 2, 1, 6)]
    agrees(spark, "multi_pattern_chain", SF)


def test_multi_pattern_has_overlapping_hits(spark, tmp_path):
    docs = [(1, "TATAA"), (2, "ACGGTACGGTACGGTA"), (3, None), (4, "")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    assert sorted(agrees(spark, "multi_pattern", str(tmp_path))) == [(1, 0, 1, 5), (2, 2, 1, 6), (2, 2, 6, 11), (2, 2, 11, 16)]


def test_multi_pattern_has_all_its_patterns(spark, tmp_path):
    spark.createDataFrame([(1, "GCAGCAGCTATAA")], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    assert sorted(agrees(spark, "multi_pattern", str(tmp_path))) == [(1, 0, 9, 13), (1, 1, 1, 5), (1, 1, 4, 8)]
    agrees(spark, "multi_pattern", SF)


def test_sql_functions_see_whole_sequences(spark, tmp_path):
    docs = [(1, "A" * 30 + "GTC"), (2, "AC"), (3, None), (4, "GCA")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    rows = agrees(spark, "sql_functions_whole", str(tmp_path))
    assert {r[0]: r[2] for r in rows if r[1] == 1} == {1: "GAC" + "T" * 30, 2: "GT", 3: "", 4: "TGC"}
    assert {r[:2] for r in rows if r[3]} == {(1, 31), (4, 1)} and len(rows) == 31 + 3
    agrees(spark, "sql_functions_whole", SF)


def test_entry_is_complete():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
