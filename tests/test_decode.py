"""The kernel against a base-by-base model, options, sources and sinks."""

import random

import pytest
from pyspark.sql import functions as F

from strandframe.operators import relational
from strandframe.operators.calls import decode, decode_calls, skipped_bases
from strandframe.operators.context import at_reference, context_sites
from strandframe.operators.sites import first_calls
from strandframe.options import ModCode, QueryOptions, parse_codes, parse_size, with_thresholds
from strandframe.plans import queries as plans
from strandframe.sinks import text as sinks
from strandframe.sources import alignments, references, tables

GENOME = {"c1": "".join(random.Random(1).choices("ACGTCG", k=400)), "c|2": "".join(random.Random(2).choices("ACGT", k=300))}
SCHEMA = alignments.SCHEMA


def random_read(rng, i):
    contig = rng.choice(list(GENOME))
    pos, at, cigar, seq = rng.randrange(0, 200), 0, [], ""
    at = pos
    if rng.random() < 0.4:
        n = rng.randint(1, 4)
        cigar.append(f"{n}S")
        seq += "".join(rng.choice("ACGT") for _ in range(n))
    for k in range(rng.randint(1, 4)):
        n = rng.randint(3, 15)
        cigar.append(f"{n}{rng.choice('M=X')}")
        seq += "".join(b if rng.random() < 0.9 else rng.choice("ACGTN") for b in GENOME[contig][at : at + n])
        at += n
        if k < 3 and rng.random() < 0.6:
            op, n = rng.choice("IDN"), rng.randint(1, 4)
            cigar.append(f"{n}{op}")
            if op == "I":
                seq += "".join(rng.choice("ACGT") for _ in range(n))
            else:
                at += n
    if cigar[-1][-1] in "IDN":
        cigar.append("1M")
        seq += GENOME[contig][at]
    flag = rng.choice([0, 16]) + rng.choice([0, 0, 0, 256, 2048, 4])
    reverse = bool(flag & 16)
    original = seq[::-1].translate(str.maketrans("ACGTN", "TGCAN")) if reverse else seq
    mm, values = "", 0
    for _ in range(rng.randint(0, 3)):
        base, codes = rng.choice([("C", "m"), ("C", "h"), ("C", "mh"), ("A", "a"), ("T", "17802"), ("N", "n"), ("U", "b")])
        total = len(original) if base == "N" else original.count(base.replace("U", "T"))
        skips, left = [], total
        while left > 0 and rng.random() < 0.7:
            s = rng.randint(0, min(3, left - 1))
            skips.append(s)
            left -= s + 1
        mm += f"{base}+{codes}{rng.choice(['', '.', '?'])}" + "".join(f",{s}" for s in skips) + ";"
        values += len(skips) * (1 if codes.isdigit() else len(codes))
    return {"record_idx": i, "qname": f"q{i}", "flag": flag, "contig": contig, "pos": pos, "cigar": "".join(cigar), "seq": seq, "data_len": len(seq), "mm": rng.choice([None, mm, mm, mm, mm]), "ml": [rng.randrange(256) for _ in range(values)], "hp": rng.choice([None, 1, 2])}


def model(read, options):
    """Base by base: rows (ref_pos, read_pos, code, ml, offset, skipped) at the reference, in order."""
    import re

    seq, reverse = read["seq"], bool(read["flag"] & 16)
    place, r, q = {}, read["pos"], 0
    for n, op in re.findall(r"(\d+)(\D)", read["cigar"]):
        for k in range(int(n)):
            if op in "M=X":
                place[q] = (r, 0)
                r, q = r + 1, q + 1
            elif op in "DN":
                r += 1
            else:
                if op == "I" and options.insertions and r > 0:
                    place[q] = (r - 1, k + 1)
                q += 1
    order = list(range(len(seq)))[:: -1 if reverse else 1]
    out, ml_at = [], 0
    wild = next((c for c in options.codes if c.code == "*"), None)
    for group in filter(None, read["mm"].split(";")):
        head, *skips = group.split(",")
        base, codes, flag = head[0].replace("U", "T"), head[2:].rstrip("?."), "?" if head.endswith("?") else "."
        target = base.translate(str.maketrans("ACGT", "TGCA")) if reverse else base
        mine = [p for p in order if base == "N" or seq[p] == target]
        keys = [codes] if codes.isdigit() else [codes[m:] for m in range(len(codes))]
        named, rank = {}, -1
        for c, s in enumerate(skips):
            rank += int(s) + 1
            named[rank] = c
        rows = [(p, named[k]) for k, p in enumerate(mine) if k in named] + [(p, None) for k, p in enumerate(mine) if k not in named and flag == "."]
        for p, call in rows:
            for m, key in enumerate(keys):
                spec = wild or next((c for c in options.codes if c.code == key), None)
                if spec is None or p not in place:
                    continue
                ref_pos, offset = place[p]
                genome = GENOME[read["contig"]]
                if not options.insertions and spec.context != "*":
                    pattern = spec.reverse_context if reverse else spec.context
                    covered = any(genome[k : k + len(pattern)] == pattern and k <= ref_pos < k + len(pattern) for k in range(len(genome)))
                    if not covered or (base != "N" and genome[ref_pos] != seq[p]):
                        continue
                value = 0 if call is None else read["ml"][ml_at + call * len(keys) + m]
                out.append((ref_pos, len(seq) - 1 - p if reverse else p, key, value, offset, call is None, spec.threshold))
        ml_at += len(skips) * len(keys)
    return out


def kept(reads, o):
    return [r for r in reads if not r["flag"] & 4 and (o.allow_secondary or not r["flag"] & 256) and not (o.skip_supplementary and r["flag"] & 2048) and r["mm"] is not None]


CASES = ["m", "m,h", "mh,h", "*", "*[CG]", "a,17802,n", "m[ACG],b", "m[*]"]


@pytest.fixture(scope="module")
def reads():
    rng = random.Random(11)
    return [random_read(rng, i) for i in range(400)]


@pytest.fixture(scope="module")
def frames(spark, reads):
    return spark.createDataFrame(reads, SCHEMA).repartition(3).cache(), spark.createDataFrame(list(GENOME.items()), "contig string, seq string").cache()


@pytest.mark.parametrize("codes", CASES)
@pytest.mark.parametrize("insertions", [False, True])
def test_view_and_freq(frames, reads, codes, insertions):
    o = QueryOptions(tuple(with_thresholds(parse_codes(codes), "0.7")), insertions=insertions, haplotypes=True)
    first, counts = {}, {}
    for r in kept(reads, o):
        strand, hap = "-" if r["flag"] & 16 else "+", r["hp"] or 0
        for ref_pos, read_pos, key, value, offset, skipped, t in model(r, o):
            first.setdefault((r["record_idx"], ref_pos, key, offset), (read_pos, (value + 0.5) / 256))
            p = (value + 0.5) / 256
            state = 0 if skipped else 1 if p >= t else 0 if p <= 1 - t else None
            for h in (str(hap), "*"):
                if state is not None:
                    n = counts.setdefault((r["contig"], ref_pos, strand, key, offset, h), [0, 0])
                    n[0] += 1
                    n[1] += state
    assert len(counts) > 20
    got = plans.view(*frames, o).collect()
    assert {(r.record_idx, r.ref_pos, r.mod_code, r.asDict().get("ins_offset", 0)): (r.read_pos, r.mod_prob) for r in got} == first and len(got) == len(first)
    got = plans.freq(*frames, o).collect()
    assert {(r.contig, r.start, r.strand, r.mod_code, r.asDict().get("ins_offset", 0), r.haplotype): [r.n_called, r.n_mod] for r in got} == counts and len(got) == len(counts)


def test_first_calls_of_kernel_and_relation(frames, reads):
    """Groups of N before and after others of the same code, so that the reference decides which call is first."""
    seqs = {r["record_idx"]: r for r in reads}
    mm = ["N+m?,0,0,0;C+m?,0;", "C+m?,0;N+m.,1,0;", "C+m.,0;N+m?,0,0,0;C+m?,0;", "A+m?,0;N+m.;"]
    rows = [r | {"mm": mm[i % 4], "ml": list(range(1, 9))} for i, r in seqs.items() if {*"ACGT"} <= set(r["seq"]) and len(r["seq"]) > 5]
    table = frames[0].sparkSession.createDataFrame(rows, SCHEMA)
    for codes in ("m[C]", "m[N]", "m[*]", "m[A]", "*[G]"):
        o = QueryOptions(tuple(parse_codes(codes)))
        want = first_calls(plans.calls(table, frames[1], o)).select("record_idx", "ref_pos", "mod_code", "read_pos", "ml", "is_skipped")
        got = plans.calls(table, frames[1], o, first=True).select(*want.columns)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and (codes == "m[N]" or want.count() > 20)


def test_reference_must_have_what_reads_name(frames):
    table, reference = frames[0].filter("mm is not null").withColumn("contig_len", F.lit(400)), frames[1]
    for o in (QueryOptions(), QueryOptions(tuple(parse_codes("*"))), QueryOptions(insertions=True)):
        for reads_, contigs in ((frames[0], reference.filter("contig = 'c1'")), (frames[0], reference.withColumn("seq", F.substring("seq", 1, 30))), (table, reference)):
            with pytest.raises(Exception, match="reference lacks|by the header"):
                plans.view(reads_, contigs, o).collect()


def test_skipped_bases_of_kernel_and_relation(frames):
    plain = frames[0].filter("(flag & 260) = 0 and mm is not null")
    got, want = (sorted(map(tuple, f(plain).collect())) for f in (skipped_bases, relational.skipped_bases))
    assert got == want and len(got) > 100


def test_chunk_join_equals_broadcast(frames, monkeypatch):
    o = QueryOptions(tuple(parse_codes("m[ACG],a")))
    whole = sorted(map(tuple, plans.calls(*frames, o).collect()), key=repr)
    monkeypatch.setattr("strandframe.operators.context.CHUNK", 64)
    small = at_reference(decode_calls(frames[0].filter("(flag & 260) = 0 and mm is not null"), o), frames[1], o, bases=1 << 40)
    assert sorted(map(tuple, small.collect()), key=repr) == whole


def test_relational_steps_equal_kernel(frames, reads):
    plain = frames[0].filter("(flag & 260) = 0 and mm is not null")
    o = QueryOptions(tuple(parse_codes("*[*]")))
    pairs = relational.aligned_pairs(plain).select("record_idx", "rp")
    n = {r.record_idx: r.n for r in relational.called_bases(plain).join(pairs, ["record_idx", "rp"]).groupBy("record_idx").agg(F.count(F.lit(1)).alias("n")).collect()}
    single = [r for r in kept(reads, o) if "mh" not in r["mm"]]
    for r in single:
        assert n.get(r["record_idx"], 0) == sum(len(x[0]) for x in decode(r, o) if not x[5])


def test_summary(frames, reads):
    got = {r.record_idx: r.modifications for r in plans.summary(frames[0]).collect()}
    want = {}
    for r in kept(reads, QueryOptions()):
        found = []
        for g in filter(None, r["mm"].split(";")):
            if "," in g:
                head = g.split(",")[0]
                entry = f"{head[0].replace('U', 'T')}|{head[2:].rstrip('?.')}|{'?' if head.endswith('?') else '.'}"
                found += [] if entry in found else [entry]
        want[r["record_idx"]] = found
    assert got == want


def test_errors():
    bad = {"record_idx": 0, "qname": "q", "flag": 0, "contig": "c1", "pos": 0, "cigar": "4M", "seq": "CCCC", "mm": "C+m,0;", "ml": None, "hp": None}
    o = QueryOptions()
    with pytest.raises(ValueError, match="ML has no value"):
        decode(bad, o)
    for change in ({"cigar": "2H4M"}, {"cigar": "3M"}, {"mm": "C+m,9;"}, {"mm": "C+m1,0;"}):
        with pytest.raises(ValueError):
            decode(bad | {"ml": [1]} | change, o)


def test_context_sites(spark):
    reference = spark.createDataFrame([("c", "ACACGACG"), ("empty", "")], "contig string, seq string")
    assert sorted(r.ref_pos for r in context_sites(reference, ModCode("x", "ACG")).collect()) == [2, 3, 4, 5, 6, 7]
    assert sorted(r.ref_pos for r in context_sites(reference, ModCode("x", "CG"), reverse=True).collect()) == [3, 4, 6, 7]


def test_option_grammar():
    assert parse_codes("m[cg]h,17802,*[*]") == [ModCode("m", "CG"), ModCode("h", "CG"), ModCode("17802", "CG"), ModCode("*", "*")]
    assert [c.threshold for c in with_thresholds(parse_codes("m,h"), "0.7")] == [0.7, 0.7]
    for text in ("m[", "m1", "m[C*]", "m,m", "m[]", "", "m;h"):
        with pytest.raises(ValueError):
            parse_codes(text)
    for text in ("2", "0.1,0.2,0.3", "x"):
        with pytest.raises(ValueError):
            with_thresholds(parse_codes("m,h"), text)
    assert [parse_size(x) for x in ("20M", "5k", "7", "1.5G")] == [20_000_000, 5000, 7, 1_500_000_000]


def sam_line(r):
    tags = ([f"MM:Z:{r['mm']}"] if r["mm"] is not None else []) + ([f"ML:B:C,{','.join(map(str, r['ml']))}"] if r["ml"] else []) + ([f"HP:i:{r['hp']}"] if r["hp"] else [])
    return "\t".join([r["qname"], str(r["flag"]), r["contig"], str(r["pos"] + 1), "60", r["cigar"], "*", "0", "0", r["seq"], "*", *tags])


def test_sources_and_command(spark, reads, tmp_path, capsys, caplog):
    from strandframe import cli

    (tmp_path / "x.sam").write_text("@HD\tVN:1.6\n" + "".join(sam_line(r) + "\n" for r in reads))
    (tmp_path / "x.bam").write_bytes(alignments.to_bam(reads, {k: len(v) for k, v in GENOME.items()}))
    (tmp_path / "ref.fa").write_text("".join(f">{k} more words\n{v[:70].lower()}\n{v[70:]}\n" for k, v in GENOME.items()))
    fields = ["qname", "flag", "contig", "pos", "cigar", "seq", "mm", "ml", "hp"]
    want = sorted((tuple(r[f] if f != "ml" else (r[f] or None) for f in fields) for r in reads), key=repr)
    for name in ("x.sam", "x.bam"):
        got = alignments.read_alignments(spark, str(tmp_path / name)).select(fields).collect()
        assert sorted((tuple(r) for r in got), key=repr) == want
    assert dict(map(tuple, references.read_reference(spark, str(tmp_path / "ref.fa")).collect())) == GENOME
    cli.main(["freq", str(tmp_path / "ref.fa"), str(tmp_path / "x.bam"), "-c", "m,h", "--skip-supplementary"])
    out = capsys.readouterr().out.splitlines()
    assert out[0].split("\t") == ["contig", "start", "end", "strand", "n_called", "n_mod", "freq", "mod_code"] and len(out) > 20
    assert [x.split("\t")[0] for x in out[1:]] == sorted(x.split("\t")[0] for x in out[1:])
    cli.main(["summary", str(tmp_path / "x.sam"), "-o", str(tmp_path / "out")])
    text = next((tmp_path / "out").glob("part-*")).read_text().splitlines()
    with caplog.at_level("INFO", "strandframe"):
        cli.main(["view", str(tmp_path / "ref.fa"), str(tmp_path / "x.bam"), "-o", str(tmp_path / "view")])
    assert f"records: {len(reads)}, skipped {len(reads) - len(kept(reads, QueryOptions()))}," in caplog.text and "MB at most" in caplog.text
    assert tables.read_view_tsv(spark, str(tmp_path / "view")).count() > 20
    assert text[0] == sinks.SUMMARY_HEADER and len(text) == 1 + len(kept(reads, QueryOptions()))
    cli.main(["mod-freq", str(tmp_path / "ref.fa"), str(tmp_path / "x.bam"), "-b"])
    assert all(len(x.split("\t")) == 11 for x in capsys.readouterr().out.splitlines())


def test_bam_splits(spark, reads, tmp_path):
    """The same records from one split and from many, in input order; two files never share numbers; long CIGARs."""
    import gzip

    one, two = reads[:300], [r | {"qname": r["qname"] + "'"} for r in reads[300:]]
    longest = max(len(x) for x in GENOME.values())
    for folder, block, most in (("a", 700, 1 << 16), ("b", 97, 4), ("c", 60_000, 2)):
        (tmp_path / folder).mkdir()
        for name, rows in (("x.bam", one), ("y.bam", two)):
            (tmp_path / folder / name).write_bytes(alignments.to_bam(rows, {c: len(s) for c, s in GENOME.items()}, block, most))
        want = [(r["qname"], r["pos"], r["cigar"], r["seq"], r["mm"], r["ml"] or None, r["hp"]) for r in one + two]
        for split in (1 << 20, 4001, 977):
            got = alignments.read_bam(spark, str(tmp_path / folder), split).orderBy("record_idx").collect()
            assert [(r.qname, r.pos, r.cigar, r.seq, r.mm, r.ml, r.hp) for r in got] == want, (folder, split)
            assert len({r.record_idx for r in got}) == len(want) and {r.contig_len for r in got} <= {None, 300, longest}
    data = (tmp_path / "a/x.bam").read_bytes()
    (tmp_path / "plain.bam").write_bytes(gzip.compress(gzip.decompress(data)))
    assert alignments.read_bam(spark, str(tmp_path / "plain.bam"), 977).count() == 300
    (tmp_path / "cut.bam").write_bytes(data[: len(data) // 2])
    with pytest.raises(Exception, match="cut off"):
        alignments.read_bam(spark, str(tmp_path / "cut.bam")).collect()


def test_reference_chunks(spark, frames, tmp_path):
    """Chunks of any split are those of the whole text; FASTQ and gzip; the last of a repeated contig stays."""
    import gzip

    rng = random.Random(8)
    contigs = {f"k{i}": "".join(rng.choices("ACGTN", k=rng.choice([0, 1, 63, 64, 65, 128, 500, 1000]))) for i in range(14)}
    text = ">k3 old one\nACGU\n" + "".join(f">{k} about {k}\n" + "".join(s[j : j + 37].lower().replace("t", rng.choice("tu")) + rng.choice(["\n", "\r\n"]) for j in range(0, len(s), 37)) + rng.choice(["", "\n"]) for k, s in contigs.items())
    (tmp_path / "r.fa").write_text(text)
    (tmp_path / "r.fa.gz").write_bytes(gzip.compress(text[:300].encode()) + gzip.compress(text[300:].encode()))
    (tmp_path / "r.fq").write_text("".join(f"@{k} x\n{s[:40]}\n{s[40:]}\n+\n{'@' * len(s[:40])}\n{'>' * len(s[40:])}\n" for k, s in contigs.items() if len(s) > 40))
    (tmp_path / "line.fa").write_text(">one\n" + contigs["k0"] * 40 + "\n>two\n" + "acgt")
    want = {(k, len(s), c, max(0, c * 64 - 9), s[max(0, c * 64 - 9) : c * 64 + 73]) for k, s in contigs.items() for c in range(max(1, -(-len(s) // 64)))}
    for name, splits in (("r.fa", (1 << 20, 777, 100, 11)), ("r.fa.gz", (50,))):
        for split in splits:
            got = references.read_reference_chunks(spark, str(tmp_path / name), 9, 64, split).collect()
            assert len(got) == len(want) and {tuple(r) for r in got} == want, (name, split)
    assert dict(map(tuple, references.read_reference(spark, str(tmp_path / "r.fq")).collect())) == {k: s for k, s in contigs.items() if len(s) > 40}
    got = references.read_reference_chunks(spark, str(tmp_path / "line.fa"), 0, 64, 333).orderBy("contig", "ref_chunk").collect()
    assert "".join(r.seq for r in got) == contigs["k0"] * 40 + "ACGT"


def test_query_on_chunks_of_files(spark, frames, reads, tmp_path):
    """Contigs in chunks, joined by key, give what whole contigs give that are sent."""
    (tmp_path / "ref.fa").write_text("".join(f">{k}\n{v[:70]}\n{v[70:]}\n" for k, v in GENOME.items()))
    o = QueryOptions(tuple(parse_codes("m[ACG],a")))
    pieces = references.read_reference_chunks(spark, str(tmp_path / "ref.fa"), 3)
    want = sorted(map(tuple, plans.calls(*frames, o).collect()), key=repr)
    assert sorted(map(tuple, plans.calls(frames[0], pieces, o).collect()), key=repr) == want
    kept_ = frames[0].filter("(flag & 260) = 0 and mm is not null")
    assert sorted(map(tuple, at_reference(decode_calls(kept_, o), pieces, o, bases=1 << 40).collect()), key=repr) == want


def test_text_tables(spark, tmp_path):
    (tmp_path / "a.bedmethyl").write_text("c1\t5\t6\tm\t10\t+\t5\t6\t255,0,0\t10\t50.000000\n")
    (tmp_path / "r.bed").write_text("c1\t2\t6\nc2\t0\t9\n")
    row = tables.read_sites(spark, str(tmp_path / "a.bedmethyl")).first()
    assert (row.contig, row.start, row.strand, row.n_called, row.n_mod) == ("c1", 5, "+", 10, 5)
    calls = spark.createDataFrame([("c1", 1), ("c1", 5), ("c1", 6), ("c2", 0)], "contig string, ref_pos int")
    assert sorted(map(tuple, tables.in_regions(calls, tables.read_regions(spark, str(tmp_path / "r.bed"))).collect())) == [("c1", 5), ("c2", 0)]


def test_fixed_decimals(spark):
    from strandframe.functions.scalars import fixed6

    values = [(m / n,) for n in range(1, 140) for m in range(n + 1)]
    rows = spark.createDataFrame(values, "x double").select("x", fixed6(F.col("x")).alias("t")).collect()
    assert all(r.t == f"{r.x:.6f}" for r in rows)


def test_streams(spark, frames, tmp_path):
    from strandframe.streaming import incremental

    o = QueryOptions(tuple(parse_codes("m")))
    frames[0].repartition(4).write.parquet(str(tmp_path / "in"))
    stream = incremental.read_stream(spark, str(tmp_path / "in"), files_per_trigger=1)
    for name, rows, mode, want in (("f", plans.freq(stream, frames[1], o), "complete", plans.freq(*frames, o)), ("s", plans.summary(stream), "append", plans.summary(frames[0]))):
        incremental.start(rows, name, str(tmp_path / name), mode).awaitTermination()
        assert sorted(map(repr, spark.table(name).collect())) == sorted(map(repr, want.collect()))
    out = str(tmp_path / "view_out")
    for _ in range(2):  # the second run finds nothing new
        incremental.start_files(plans.view(stream, frames[1], o), out, str(tmp_path / "view")).awaitTermination()
        incremental.start_counts(stream, frames[1], o, str(tmp_path / "counts"), str(tmp_path / "c")).awaitTermination()
    assert sorted(map(repr, spark.read.parquet(out).collect())) == sorted(map(repr, plans.view(*frames, o).collect()))
    assert len(list((tmp_path / "counts").glob("batch=*"))) == 4
    assert sorted(map(repr, incremental.total_counts(spark, str(tmp_path / "counts")).collect())) == sorted(map(repr, plans.freq(*frames, o).collect()))
