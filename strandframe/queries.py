"""The driver's queries: one for each operator, on reads made from its tables, with SQL twins.

The twins decode relationally (one row for each base), the queries by the one-pass kernel or by the step
operators, so that each checks the other.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandframe import roundtrips
from strandframe.operators import calls, compare, context, reads, relational
from strandframe.options import ModCode, QueryOptions, parse_codes, with_thresholds
from strandframe.plans import queries as plans
from strandframe.synth import ctes, reads_and_reference

Query = Callable[[SparkSession, str], DataFrame]


def options(codes: str = "m", thresholds: str | None = None, **flags: bool) -> QueryOptions:
    return QueryOptions(tuple(with_thresholds(parse_codes(codes), thresholds)), **flags)


# SQL -------------------------------------------------------------------------------------------------------------


def kept_sql(allow_secondary: bool = False, skip_supplementary: bool = False) -> str:
    more = "" if allow_secondary else " AND (flag & 256) = 0"
    more += " AND (flag & 2048) = 0" if skip_supplementary else ""
    return f"kept AS (SELECT * FROM reads WHERE (flag & 4) = 0 AND seq <> '' AND mm IS NOT NULL{more})"


SEGMENTS = """ops AS (SELECT record_idx, pos, unnest(range(len(regexp_extract_all(cigar, '[A-Z=]')))) AS seg_no, unnest(regexp_extract_all(cigar, '[A-Z=]')) AS op, unnest(regexp_extract_all(cigar, '[0-9]+'))::INT AS len FROM kept),
     segments AS (SELECT record_idx, seg_no::INT AS seg_no, op, len,
            coalesce(sum(CASE WHEN op IN ('M', 'I', 'S', '=', 'X') THEN len ELSE 0 END) OVER w, 0)::INT AS read_start,
            (pos + coalesce(sum(CASE WHEN op IN ('M', 'D', 'N', '=', 'X') THEN len ELSE 0 END) OVER w, 0))::INT AS ref_start
            FROM ops WINDOW w AS (PARTITION BY record_idx ORDER BY seg_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"""


def pairs_sql(insertions: bool) -> str:
    kinds = "('M', '=', 'X', 'I')" if insertions else "('M', '=', 'X')"
    return f"""pairs AS (SELECT * FROM (SELECT record_idx, (read_start + j)::INT AS rp, (CASE WHEN op = 'I' THEN ref_start - 1 ELSE ref_start + j END)::INT AS ref_pos, (CASE WHEN op = 'I' THEN j + 1 ELSE 0 END)::INT AS ins_offset
            FROM segments, unnest(range(len)) AS u(j) WHERE op IN {kinds}) WHERE ref_pos >= 0)"""


STEPS = r"""bases AS (SELECT record_idx, rp, base, row_number() OVER (PARTITION BY record_idx, base ORDER BY CASE WHEN (flag & 16) <> 0 THEN -rp ELSE rp END) - 1 AS rank,
            row_number() OVER (PARTITION BY record_idx ORDER BY CASE WHEN (flag & 16) <> 0 THEN -rp ELSE rp END) - 1 AS rank_any
            FROM (SELECT record_idx, flag, unnest(range(length(seq)))::INT AS rp, unnest(string_split(seq, '')) AS base FROM kept)),
     raw AS (SELECT record_idx, flag AS bits, unnest(range(len(string_split(mm, ';'))))::INT AS grp, unnest(string_split(mm, ';')) AS g FROM kept),
     parsed AS (SELECT record_idx, bits, grp, replace(upper(g[1]), 'U', 'T') AS base, regexp_extract(g, '^.[+-]([A-Za-z]+|[0-9]+)', 1) AS codes,
            CASE WHEN g LIKE '%?%' THEN '?' ELSE '.' END AS flag, list_transform(regexp_extract_all(g, ',([0-9]+)', 1), lambda x: x::INT) AS skips FROM raw WHERE g <> ''),
     groups AS (SELECT *, CASE WHEN codes ~ '^[0-9]' THEN [codes] ELSE list_transform(range(1, length(codes) + 1), lambda i: substr(codes, i)) END AS lookup,
            CASE WHEN (bits & 16) <> 0 THEN translate(base, 'ACGT', 'TGCA') ELSE base END AS target FROM parsed),
     starts AS (SELECT *, coalesce(sum(len(skips) * len(lookup)) OVER (PARTITION BY record_idx ORDER BY grp ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS first_ml FROM groups),
     calls AS (SELECT record_idx, grp, base, call, sum(skip + 1) OVER (PARTITION BY record_idx, grp ORDER BY call) - 1 AS rank, first_ml + call * len(lookup) AS ml_start
            FROM (SELECT *, unnest(range(len(skips)))::INT AS call, unnest(skips) AS skip FROM starts)),
     ranked AS (SELECT g.record_idx, g.grp, b.rp, CASE WHEN g.target = 'N' THEN b.rank_any ELSE b.rank END AS rank FROM groups g JOIN bases b ON g.record_idx = b.record_idx AND (g.target = 'N' OR g.target = b.base)),
     stated AS (SELECT r.record_idx, r.grp, r.rp, r.rank, c.call, c.ml_start FROM ranked r LEFT JOIN calls c ON r.record_idx = c.record_idx AND r.grp = c.grp AND r.rank = c.rank)"""


def decoded_sql(o: QueryOptions) -> str:
    """``obs``: all calls of requested codes at the reference."""
    sought = o.sought()
    code = "'*'" if o.wildcard else "code"
    per = lambda value: "CASE sought " + " ".join(f"WHEN '{c.code}' THEN {value(c)}" for c in sought.values()) + " END"

    def test(c: ModCode) -> str:
        if c.context == "*" or o.insertions:
            return "true"
        m = len(c.context)
        pattern = f"CASE WHEN strand = '-' THEN '{c.reverse_context}' ELSE '{c.context}' END"
        return f"contains(substr(ref, greatest(ref_pos - {m - 1}, 0) + 1, ref_pos + {m} - greatest(ref_pos - {m - 1}, 0)), {pattern}) AND (target = 'N' OR substr(ref, ref_pos + 1, 1) = read_base)"

    return f"""{ctes(True)}, {kept_sql(o.allow_secondary, o.skip_supplementary)}, {SEGMENTS}, {pairs_sql(o.insertions)}, {STEPS},
     evidence AS (SELECT s.*, g.target, g.base, unnest(range(len(g.lookup))) AS m, unnest(g.lookup) AS code FROM stated s JOIN groups g ON s.record_idx = g.record_idx AND s.grp = g.grp WHERE s.call IS NOT NULL OR g.flag = '.'),
     observed AS (SELECT e.record_idx, k.qname, k.contig, p.ref_pos, CASE WHEN (k.flag & 16) <> 0 THEN '-' ELSE '+' END AS strand, CASE WHEN (k.flag & 16) <> 0 THEN length(k.seq) - 1 - e.rp ELSE e.rp END AS read_pos, e.code AS mod_code,
            CASE WHEN e.call IS NULL THEN 0 ELSE k.ml[e.ml_start + e.m + 1] END AS ml, p.ins_offset, coalesce(k.hp, 0) & 255 AS haplotype, e.call IS NULL AS is_skipped, e.grp, e.m, e.rank, e.target, substr(k.seq, e.rp + 1, 1) AS read_base, c.seq AS ref, {code} AS sought
            FROM evidence e JOIN kept k ON e.record_idx = k.record_idx JOIN pairs p ON e.record_idx = p.record_idx AND e.rp = p.rp JOIN contigs c ON c.contig = k.contig
            WHERE {"true" if o.wildcard else "e.code IN (" + ", ".join(f"'{x}'" for x in sought) + ")"}),
     obs AS (SELECT *, (ml + 0.5::DOUBLE) / 256.0::DOUBLE AS prob, {per(lambda c: f"{c.threshold!r}::DOUBLE")} AS threshold FROM observed WHERE {per(test)})"""


def view_sql(o: QueryOptions) -> str:
    more = (", ins_offset" if o.insertions else "") + (", haplotype" if o.haplotypes else "")
    return f"""WITH {decoded_sql(o)},
     firsts AS (SELECT *, row_number() OVER (PARTITION BY record_idx, contig, ref_pos, strand, mod_code, ins_offset ORDER BY grp, is_skipped, rank, m) AS n FROM obs)
     SELECT record_idx, contig AS ref_contig, ref_pos, strand, qname AS read_id, read_pos::INT AS read_pos, mod_code, prob AS mod_prob{more} FROM firsts WHERE n = 1"""


def counts_sql(o: QueryOptions) -> str:
    keys = "contig, ref_pos, strand, mod_code" + (", ins_offset" if o.insertions else "")
    grouping = f"GROUPING SETS (({keys}, haplotype), ({keys}))" if o.haplotypes else keys
    hap = ", CASE WHEN grouping(haplotype) = 1 THEN '*' ELSE haplotype::VARCHAR END AS haplotype" if o.haplotypes else ""
    return f"""{decoded_sql(o)},
     classified AS (SELECT *, CASE WHEN is_skipped THEN 0 WHEN prob >= threshold THEN 1 WHEN prob <= 1.0::DOUBLE - threshold THEN 0 END AS is_mod FROM obs),
     counts AS (SELECT {keys}{hap}, count(*)::BIGINT AS n_called, sum(is_mod)::BIGINT AS n_mod FROM classified WHERE is_mod IS NOT NULL GROUP BY {grouping})"""


def freq_sql(o: QueryOptions) -> str:
    more = (", ins_offset" if o.insertions else "") + (", haplotype" if o.haplotypes else "")
    return f'WITH {counts_sql(o)} SELECT contig, ref_pos AS start, ref_pos AS "end", strand, n_called, n_mod, n_mod::DOUBLE / n_called AS freq, mod_code{more} FROM counts'


# Queries ---------------------------------------------------------------------------------------------------------


def _of_reads(run: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: run(reads.filter_reads(reads_and_reference(spark, sf_dir)[0]))


def _view(o: QueryOptions) -> Query:
    return lambda spark, sf_dir: plans.view(*reads_and_reference(spark, sf_dir), o)


def _freq(o: QueryOptions) -> Query:
    return lambda spark, sf_dir: plans.freq(*reads_and_reference(spark, sf_dir), o)


VIEWS = {
    "view_default": options(),
    "view_all_contexts": options("m[*],h[*],a[*]"),
    "view_wildcard": options("*"),
    "view_wildcard_context": options("*[CG]"),
    "view_chebi": options("17802[T],21839[C],19229[G]"),
    "view_multi_letter": options("mh,h"),
    "view_insertions": options("m,a", insertions=True),
    "view_haplotypes": options("m", haplotypes=True),
    "view_long_context": options("m[ACG],a[GAC]"),
}
FREQS = {
    "freq_default": options(),
    "freq_multi_threshold": options("m,h,a", "0.8,0.7,0.9"),
    "freq_wildcard": options("*"),
    "freq_insertions": options("m,a", insertions=True),
    "freq_haplotypes": options("m", haplotypes=True),
    "freq_insertions_haplotypes": options("m[*],h", insertions=True, haplotypes=True),
    "freq_no_supplementary": options("m", skip_supplementary=True),
    "freq_allow_secondary": options("m", allow_secondary=True),
    "freq_low_threshold": options("m", "0.3"),
}
SPLIT = "record_idx % 2 = {}"


def bedmethyl(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plans.bedmethyl(_freq(FREQS["freq_default"])(spark, sf_dir))


def summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plans.summary(reads_and_reference(spark, sf_dir)[0])


def filter_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reads_and_reference(spark, sf_dir)[0].select("record_idx", "flag", reads.skip_reason().alias("reason"))


def skip_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reads.counters(reads_and_reference(spark, sf_dir)[0])


def _sites(o: ModCode, reverse: bool) -> Query:
    return lambda spark, sf_dir: context.context_sites(reads_and_reference(spark, sf_dir)[1], o, reverse)


def _sites_sql(o: ModCode, reverse: bool) -> str:
    pattern, m = o.reverse_context if reverse else o.context, len(o.context)
    return f"WITH {ctes(True)} SELECT DISTINCT contig, (p + j)::INT AS ref_pos FROM (SELECT contig, seq, unnest(range(length(seq) - {m - 1})) AS p FROM contigs), unnest(range({m})) AS u(j) WHERE substr(seq, p + 1, {m}) = '{pattern}'"


def _halves(spark: SparkSession, sf_dir: str, query: Callable[..., DataFrame]) -> tuple[DataFrame, DataFrame]:
    rows, reference = reads_and_reference(spark, sf_dir)
    return tuple(query(rows.filter(SPLIT.format(i)), reference, options()) for i in (0, 1))


def compare_freq(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = (x.withColumn("percent", F.col("freq") * 100) for x in _halves(spark, sf_dir, plans.freq))
    return compare.compare(a, b, ["contig", "start", "strand", "mod_code"], "percent", compare.PERCENT_TOLERANCE)


def compare_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls of all reads against those of a pass that skips supplementary records and lifts the values of some."""
    rows, reference = reads_and_reference(spark, sf_dir)
    changed = rows.withColumn("ml", F.expr("if(record_idx % 5 = 0, transform(ml, x -> x div 2), ml)"))
    a, b = plans.view(rows, reference, options()), plans.view(changed, reference, options(skip_supplementary=True))
    return compare.compare(a, b, ["ref_contig", "ref_pos", "strand", "read_id", "read_pos", "mod_code"], "mod_prob", compare.VIEW_TOLERANCE)


def freq_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare.frequency_correlation(*_halves(spark, sf_dir, plans.freq)).select("n_sites", F.round("r", 9).alias("r"))


def freq_from_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare.freq_from_view(_view(VIEWS["view_default"])(spark, sf_dir), "m")


def strand_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare.folded(_freq(FREQS["freq_default"])(spark, sf_dir))


def contig_presence(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, reference = reads_and_reference(spark, sf_dir)
    return context.on_contigs(rows, reference.filter("contig like '%1%'")).select("record_idx", "contig")


def queries() -> dict[str, Query]:
    found: dict[str, Query] = {
        "reads_filter_flags": filter_flags,
        "skip_counters": skip_counters,
        "cigar_segments": _of_reads(relational.cigar_segments),
        "aligned_pairs": _of_reads(relational.aligned_pairs),
        "aligned_pairs_insertions": _of_reads(lambda r: relational.aligned_pairs(r, insertions=True)),
        "base_rank": _of_reads(relational.base_ranks),
        "mm_groups": _of_reads(lambda r: relational.mm_groups(r).select("record_idx", "grp", "base", "codes", "flag", F.concat_ws(",", F.col("skips").cast("array<string>")).alias("skips"), F.concat_ws(",", "lookup").alias("lookup"))),
        "mm_call_rank": _of_reads(relational.mm_calls),
        "ml_lookup": _of_reads(relational.ml_values),
        "called_bases": _of_reads(relational.called_bases),
        "skipped_bases": _of_reads(calls.skipped_bases),
        "context_sites_fwd": _sites(ModCode("x", "ACG"), False),
        "context_sites_rev": _sites(ModCode("x", "ACG"), True),
    }
    found |= {k: _view(o) for k, o in VIEWS.items()} | {k: _freq(o) for k, o in FREQS.items()}
    return found | roundtrips.queries() | {"contig_presence": contig_presence, "freq_bedmethyl": bedmethyl, "freq_from_view": freq_from_view, "summary": summary, "compare_view": compare_view, "compare_freq": compare_freq, "freq_correlation": freq_correlation, "strand_fold": strand_fold}


def oracle_summary() -> str:
    return f"""WITH {ctes(True)}, {kept_sql()}, g AS (SELECT record_idx, unnest(range(len(string_split(mm, ';')))) AS i, unnest(string_split(mm, ';')) AS g FROM kept),
     e AS (SELECT record_idx, i, replace(upper(g[1]), 'U', 'T') || '|' || regexp_extract(g, '^.[+-]([A-Za-z]+|[0-9]+)', 1) || '|' || CASE WHEN g LIKE '%?%' THEN '?' ELSE '.' END AS entry FROM g WHERE g LIKE '%,%'),
     f AS (SELECT record_idx, entry, min(i) AS i FROM e GROUP BY ALL), l AS (SELECT record_idx, list(entry ORDER BY i) AS entries FROM f GROUP BY record_idx)
     SELECT k.record_idx, qname AS read_id, coalesce(entries, []) AS modifications FROM kept k LEFT JOIN l ON k.record_idx = l.record_idx"""


def oracle_sql() -> dict[str, str]:
    base = f"WITH {ctes(True)}, {kept_sql()}"
    steps = f"{base}, {STEPS}"
    half = lambda i: counts_sql(options()).replace("FROM reads WHERE", f"FROM reads WHERE {SPLIT.format(i)} AND")
    both = f"a AS (WITH {half(0)} SELECT * FROM counts), b AS (WITH {half(1)} SELECT * FROM counts)"
    outcome = "CASE WHEN a.k IS NULL THEN 'missing_in_file1' WHEN b.k IS NULL THEN 'missing_in_file2' WHEN abs(a.v - b.v) > {} THEN 'large_diff' ELSE 'in_both' END AS outcome"
    fold = "SELECT contig, CASE WHEN strand = '-' THEN ref_pos - 1 ELSE ref_pos END AS start, sum(n_called)::BIGINT AS n_called, sum(n_mod)::BIGINT AS n_mod FROM {} GROUP BY ALL"
    changed = view_sql(options(skip_supplementary=True)).replace("k.ml[e.ml_start + e.m + 1]", "(CASE WHEN k.record_idx % 5 = 0 THEN k.ml[e.ml_start + e.m + 1] // 2 ELSE k.ml[e.ml_start + e.m + 1] END)")
    found = {
        "reads_filter_flags": f"WITH {ctes(True)} SELECT record_idx, flag, CASE WHEN (flag & 4) <> 0 THEN 'unmapped' WHEN (flag & 256) <> 0 THEN 'secondary' WHEN seq = '' THEN 'empty' WHEN mm IS NULL THEN 'no tag' END AS reason FROM reads",
        "skip_counters": f"{base} SELECT count(*)::BIGINT AS total_reads, (count(*) - count(k.record_idx))::BIGINT AS skipped_reads, count(k.record_idx)::BIGINT AS processed_reads, sum(length(r.seq))::BIGINT AS total_bytes, sum(length(k.seq))::BIGINT AS processed_bytes FROM reads r LEFT JOIN kept k ON r.record_idx = k.record_idx",
        "cigar_segments": f"{base}, {SEGMENTS} SELECT * FROM segments",
        "aligned_pairs": f"{base}, {SEGMENTS}, {pairs_sql(False)} SELECT * FROM pairs",
        "aligned_pairs_insertions": f"{base}, {SEGMENTS}, {pairs_sql(True)} SELECT * FROM pairs",
        "base_rank": f"{steps} SELECT record_idx, rp, base, rank::INT AS rank, rank_any::INT AS rank_any FROM bases",
        "mm_groups": f"{steps} SELECT record_idx, grp, base, codes, flag, array_to_string(skips, ',') AS skips, array_to_string(lookup, ',') AS lookup FROM groups",
        "mm_call_rank": f"{steps} SELECT record_idx, grp, base, call, rank::BIGINT AS rank, ml_start::BIGINT AS ml_start FROM calls",
        "ml_lookup": f"{steps} SELECT v.record_idx, v.grp, v.call, v.code, k.ml[v.ml_start + v.m + 1] AS ml FROM (SELECT c.*, unnest(range(len(g.lookup))) AS m, unnest(g.lookup) AS code FROM calls c JOIN groups g ON c.record_idx = g.record_idx AND c.grp = g.grp) v JOIN kept k ON v.record_idx = k.record_idx",
        "called_bases": f"{steps} SELECT record_idx, grp, call, rank::BIGINT AS rank, rp FROM stated WHERE call IS NOT NULL",
        "contig_presence": f"WITH {ctes(True)} SELECT record_idx, contig FROM reads WHERE contig LIKE '%1%'",
        "skipped_bases": f"{steps} SELECT s.record_idx, s.grp, s.rank::INT AS rank, s.rp FROM stated s JOIN groups g ON s.record_idx = g.record_idx AND s.grp = g.grp WHERE s.call IS NULL AND g.flag = '.'",
        "context_sites_fwd": _sites_sql(ModCode("x", "ACG"), False),
        "context_sites_rev": _sites_sql(ModCode("x", "ACG"), True),
        "freq_bedmethyl": f"WITH {counts_sql(options())} SELECT contig, ref_pos AS start, ref_pos + 1 AS \"end\", mod_code AS name, n_called AS score, strand, ref_pos AS thick_start, ref_pos + 1 AS thick_end, '255,0,0' AS color, n_called AS coverage, n_mod * 100.0::DOUBLE / n_called AS percent FROM counts",
        "freq_from_view": f"WITH v AS ({view_sql(options())}), s AS (SELECT *, CASE WHEN mod_prob >= 0.8::DOUBLE THEN 1 WHEN mod_prob <= 1.0::DOUBLE - 0.8::DOUBLE THEN 0 END AS state FROM v WHERE mod_code = 'm') SELECT ref_contig AS contig, ref_pos, strand, mod_code, sum(state)::DOUBLE / count(*) AS frequency FROM s WHERE state IS NOT NULL GROUP BY ALL",
        "compare_view": f"WITH a AS (SELECT *, 1 AS k, mod_prob AS v FROM ({view_sql(options())})), b AS (SELECT *, 1 AS k, mod_prob AS v FROM ({changed})) SELECT ref_contig, ref_pos, strand, read_id, read_pos, mod_code, a.v AS value_1, b.v AS value_2, abs(a.v - b.v) AS diff, {outcome.format('0.002::DOUBLE')} FROM a FULL OUTER JOIN b USING (ref_contig, ref_pos, strand, read_id, read_pos, mod_code)",
        "compare_freq": f"WITH {both}, x AS (SELECT *, 1 AS k, n_mod::DOUBLE / n_called * 100 AS v FROM a), y AS (SELECT *, 1 AS k, n_mod::DOUBLE / n_called * 100 AS v FROM b) SELECT contig, ref_pos AS start, strand, mod_code, a.v AS value_1, b.v AS value_2, abs(a.v - b.v) AS diff, {outcome.format('5.0::DOUBLE')} FROM x a FULL OUTER JOIN y b USING (contig, ref_pos, strand, mod_code)",
        "freq_correlation": f"WITH {both}, x AS ({fold.format('a')}), y AS ({fold.format('b')}) SELECT count(*)::BIGINT AS n_sites, round(coalesce(corr(x.n_mod::DOUBLE / x.n_called, y.n_mod::DOUBLE / y.n_called), 0), 9) AS r FROM x JOIN y USING (contig, start)",
        "strand_fold": f"WITH {counts_sql(options())} {fold.format('counts')}",
    }
    found["summary"] = oracle_summary()
    found |= {k: view_sql(o) for k, o in VIEWS.items()} | {k: freq_sql(o) for k, o in FREQS.items()}
    return found | file_sql()


def file_sql() -> dict[str, str]:
    """What comes back from files, as it was before it was written."""
    six = lambda x: f"printf('%.6f', {x})::DOUBLE"
    fields = "qname, flag, contig, pos, cigar, seq, mm, ml, hp"
    freq, view, every = (f"({x(o)})" for x, o in ((freq_sql, options()), (view_sql, options()), (freq_sql, roundtrips.ALL)))
    pad, chunk = roundtrips.PAD, roundtrips.CHUNK
    outcome = "CASE WHEN a.k IS NULL THEN 'missing_in_file1' WHEN b.k IS NULL THEN 'missing_in_file2' WHEN abs(a.v - b.v) > {}::DOUBLE THEN 'large_diff' ELSE 'in_both' END AS outcome"
    values = "a.v AS value_1, b.v AS value_2, abs(a.v - b.v) AS diff"
    fewer = f"({view_sql(options(skip_supplementary=True))})"
    return {
        "file_sam": f"WITH {ctes(True)} SELECT {fields} FROM reads",
        "file_bam": f"WITH {ctes(True)} SELECT r.*, length(c.seq)::INT AS contig_len FROM (SELECT {fields} FROM reads) r JOIN contigs c USING (contig)",
        "file_fasta_chunks": f"WITH {ctes(True)} SELECT contig, length(seq)::INT AS ref_len, n::INT AS ref_chunk, greatest(n * {chunk} - {pad}, 0)::INT AS ref_offset, substr(seq, greatest(n * {chunk} - {pad}, 0) + 1, (n + 1) * {chunk} + {pad} - greatest(n * {chunk} - {pad}, 0)) AS seq FROM contigs, unnest(range((length(seq) + {chunk - 1}) // {chunk})) AS u(n)",
        "file_freq_by_chunk": freq_sql(options()),
        "file_view_tsv": f"SELECT ref_contig, ref_pos, strand, read_id, read_pos, mod_code, {six('mod_prob')} AS mod_prob FROM {view}",
        "file_freq_tsv": f'SELECT contig, start, "end", strand, n_called, n_mod, {six("freq")} AS freq, mod_code, ins_offset, haplotype FROM {every}',
        "file_bedmethyl": f'SELECT contig, start, start + 1 AS "end", mod_code, strand, n_called, percent, trunc(percent / 100 * n_called)::BIGINT AS n_mod FROM (SELECT *, {six("n_mod * 100.0::DOUBLE / n_called")} AS percent FROM {freq})',
        "file_summary": f"SELECT read_id || chr(9) || array_to_string(list_transform(modifications, lambda x: x || ' '), '') AS value FROM ({oracle_summary()})",
        "file_regions": f"SELECT contig, start, strand, n_called, mod_code FROM {freq} WHERE start >= length(contig) * 3 AND start < length(contig) * 20",
        "file_truth_tsv": f"SELECT contig, start, strand, n_called, n_mod FROM {freq} WHERE strand = '+' AND start % 2 = 0",
        "compare_view_extract": f"WITH a AS (SELECT *, 1 AS k, mod_prob AS v FROM {view}), b AS (SELECT *, 1 AS k, mod_prob AS v FROM {fewer}) SELECT ref_contig, ref_pos, strand, read_id, read_pos, mod_code, {values}, {outcome.format('0.002')} FROM a FULL OUTER JOIN b USING (ref_contig, ref_pos, strand, read_id, read_pos, mod_code)",
        "compare_freq_script": f"WITH a AS (SELECT *, 1 AS k, freq AS v FROM {freq}), b AS (SELECT *, 1 AS k, floor((freq + CASE WHEN start % 7 = 0 THEN 0.25::DOUBLE ELSE 0 END) * 100 + 0.5) / 100 AS v FROM {freq}) SELECT contig, start, strand, mod_code, {values}, {outcome.format('0.005')} FROM a FULL OUTER JOIN b USING (contig, start, strand, mod_code)",
        "order_freq": f"SELECT contig, start, strand, mod_code, ins_offset, haplotype, row_number() OVER (ORDER BY encode(contig), start, strand, mod_code, ins_offset, haplotype) - 1 AS place FROM {every}",
        "order_view": f"SELECT record_idx, ref_pos, strand, mod_code, row_number() OVER (ORDER BY record_idx, encode(ref_contig), ref_pos, strand, mod_code) - 1 AS place FROM {view}",
        "observed_counters": f"WITH {ctes(True)}, {kept_sql()} SELECT (SELECT count(*) FROM reads)::BIGINT AS total_reads, (SELECT count(*) FROM kept)::BIGINT AS processed_reads",
    }
