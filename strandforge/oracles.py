"""DuckDB SQL for the queries of ``queries``."""

from __future__ import annotations

from .functions.alphabets import AA, AMINO, BACKGROUND, codons
from .operators.splits import MODULUS, round_keys
from .operators.tag_index import most_mismatches, seeds_of
from .queries import ALTERED, COLUMN_TAGS, CROSSED, PAIRED, PARENT, SHIFT, TABLES, TAGS, made_library

_AA = f"""(SELECT doc_id, regexp_replace(upper(regexp_replace(coalesce(text, ''), '[^A-Za-z]', '', 'g')), '[^{AMINO}]', '', 'g') AS aa_seq FROM documents)"""
_DNA = """(SELECT doc_id, translate(upper(regexp_replace(coalesce(text, ''), '[^A-Za-z]', '', 'g')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'ACGTACGTACGTACGTACGTACGTAC') AS dna_seq FROM documents)"""


def _coded(shift: int = 0) -> str:
    return f"""(SELECT p_partkey, p_retailprice AS price, CAST(p_size AS DOUBLE) AS size, p_partkey % 50 AS a, p_partkey % 50 + 7 AS b,
      substr('{PARENT}', p_partkey % 50 + 1, 1) AS sa, substr('{PARENT}', p_partkey % 50 + 8, 1) AS sb,
      substr('{AMINO}', p_size % 20 + 1, 1) AS ta, substr('{AMINO}', (p_size + 3) % 20 + 1, 1) AS tb,
      CASE WHEN p_partkey = 1 THEN 'wildtype' ELSE sa || (a + 1 + {shift}) || ta || '_' || sb || (b + 1 + {shift}) || tb END AS aa_mut FROM part)"""


_MUTS = f"(SELECT p_partkey, a AS pos, sa AS src, ta AS targ FROM {_coded()} WHERE p_partkey <> 1 UNION ALL SELECT p_partkey, b, sb, tb FROM {_coded()} WHERE p_partkey <> 1)"
_APPLIED = f"(SELECT p_partkey, CASE WHEN p_partkey = 1 THEN '{PARENT}' ELSE substr('{PARENT}', 1, a) || ta || substr('{PARENT}', a + 2, 6) || tb || substr('{PARENT}', b + 2) END AS aa_seq FROM {_coded()})"
_PLACE = "(SELECT {key} AS k, row_number() OVER (ORDER BY md5('{seed}:' || {key}), {key}) - 1 AS place, count(*) OVER () AS n FROM {table})"
_FOLDS = f"(SELECT k AS doc_id, 'split_' || least(place // (n // 7), 6) AS fold FROM {_PLACE.format(key='doc_id', seed=42, table='documents')})"
_TURNS = "(SELECT conv_id, max(turn)::INT AS last FROM conversations GROUP BY 1 HAVING max(turn) > 0)"
_EDGES = f"(SELECT conv_id, last, i::INT AS edge, i::INT AS src, CASE WHEN i = last THEN 0 ELSE i + 1 END::INT AS dst FROM (SELECT *, unnest(range(0, last + 1)) AS i FROM {_TURNS}))"
_CELLS = f"(SELECT DISTINCT conv_id, row, col FROM (SELECT conv_id, src AS row, dst AS col FROM {_EDGES} UNION ALL SELECT conv_id, dst, src FROM {_EDGES}))"
_LIBRARY = "(VALUES " + ", ".join(f"({i}, '{n}', '{s}', '{'fusion' if n.endswith('Fusion') else 'leader' if n.endswith('Leader') else 'purification'}')" for i, (n, s) in enumerate(TAGS)) + ") AS lib(place, name, tag, type)"
_TAGGED = f"(SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'MGSSHHHHHHSSG' ELSE '' END || aa_seq || CASE WHEN doc_id % 7 = 0 THEN 'DYKDDDDK' ELSE '' END AS s FROM {_AA})"
_HITS = f"""(SELECT doc_id, place, type, name, length(tag) AS n, length(s) AS len, CAST(start AS INT) AS start, round_even(100.0 * (length(tag) - hamming(substr(s, CAST(start AS INT) + 1, length(tag)), tag)) / length(tag), 2) AS identity
   FROM (SELECT *, unnest(range(0, length(s) - length(tag) + 1)) AS start FROM {_TAGGED}, {_LIBRARY}
         WHERE length(tag) < length(s) AND (type <> 'fusion' OR length(s) - length(tag) >= 25)))"""
# of each family the longest first, then those that no kept one holds or lies in
_KEPT = f"""(WITH l AS (SELECT doc_id, split_part(name, '-', 1) AS family, list([{{'s': start, 'e': CAST(start + n AS INT), 'name': name, 'type': type}}] ORDER BY -n, place, start) AS v FROM {_HITS} WHERE identity >= 90 GROUP BY 1, 2)
   SELECT doc_id, unnest(list_reduce(v, lambda a, x: CASE WHEN len(list_filter(a, lambda y: (x[1].s <= y.s AND y.e <= x[1].e) OR (y.s <= x[1].s AND x[1].e <= y.e))) > 0 THEN a ELSE a || x END)) AS h FROM l)"""
# the walk inwards from each end, over hits in order: where it is, and whether it goes on
_NEAR = "abs({gap}) <= CASE WHEN x.e - x.s <= 4 THEN x.e - x.s - 1 ELSE 4 END"
_STEP = "lambda a, x: CASE WHEN a.on AND " + _NEAR + " THEN {{'at': {inner}, 'on': true, 's': a.s, 'e': a.e}} ELSE {{'at': a.at, 'on': false, 's': a.s, 'e': a.e}} END"
_ENDS = f"""(WITH d AS (SELECT doc_id, s AS seq, length(s) AS n FROM {_TAGGED}),
   v AS (SELECT doc_id, list({{'at': 0, 'on': true, 's': h.s, 'e': h.e}} ORDER BY h.s, h.e) AS front, list({{'at': 0, 'on': true, 's': h.s, 'e': h.e}} ORDER BY -h.e, h.s) AS back FROM {_KEPT} GROUP BY 1),
   w AS (SELECT d.*, list_reduce([{{'at': 0, 'on': true, 's': 0, 'e': 0}}] || coalesce(front, []), {_STEP.format(gap="x.s - a.at", inner="x.e")}).at AS f,
                list_reduce([{{'at': CAST(n AS INT), 'on': true, 's': 0, 'e': 0}}] || coalesce(back, []), {_STEP.format(gap="x.e - a.at", inner="x.s")}).at AS c_start FROM d LEFT JOIN v USING (doc_id))
   SELECT doc_id, seq, n, CAST(f + greatest(instr(substr(seq, f + 1, 4), 'M') - 1, 0) AS INT) AS n_end, CAST(c_start AS INT) AS c_start FROM w)"""
_PLACED = f"""(SELECT * FROM (SELECT e.*, h.name, h.s, h.e, CASE WHEN h.type <> 'leader' AND h.s >= c_start AND (h.e - h.s > 4 OR abs(h.e - n) <= h.e - h.s - 1) THEN 'C-terminus'
   WHEN h.e <= n_end AND (h.e - h.s > 4 OR h.s <= h.e - h.s - 1) THEN 'N-terminus' WHEN h.type = 'purification' THEN 'Internal' END AS location FROM {_ENDS} e JOIN {_KEPT} USING (doc_id)) WHERE location IS NOT NULL)"""
_REMOVED = f"(SELECT doc_id, string_agg(name, ',' ORDER BY s, e, name) AS names, count(*) AS n, count(*) FILTER (location = 'N-terminus') AS front FROM {_PLACED} WHERE location <> 'Internal' GROUP BY 1)"
_JS = f"""(WITH c AS (SELECT doc_id, aa_seq, unnest([{", ".join(f"'{a}'" for a in AMINO)}]) AS a, unnest([{", ".join(str(BACKGROUND[a] / sum(BACKGROUND.values())) for a in AMINO)}]) AS q FROM {_AA} WHERE aa_seq <> ''),
   s AS (SELECT doc_id, aa_seq, q, (length(aa_seq) - length(replace(aa_seq, a, ''))) / length(aa_seq)::DOUBLE + 1e-16 AS p FROM c),
   n AS (SELECT doc_id, aa_seq, q, p / sum(p) OVER (PARTITION BY doc_id) AS p FROM s)
   SELECT doc_id, any_value(aa_seq) AS aa_seq, sqrt(greatest(sum(p * ln(p / ((p + q) / 2)) / 2 + q * ln(q / ((p + q) / 2)) / 2), 0)) AS distance FROM n GROUP BY 1)"""
_CODONS = "MAP {" + ", ".join(f"'{c}': '{a}'" for c, a in codons().items()) + "}"
_CODON_ROWS = "(VALUES " + ", ".join(f"('{c}', '{a}')" for c, a in codons().items()) + ") AS c(codon, acid)"
_SIMILAR = f"(SELECT x.acid AS row_sym, y.acid AS col_sym, 3.0::DOUBLE - min(hamming(x.codon, y.codon)) AS score FROM {_CODON_ROWS.replace('AS c', 'AS x')}, {_CODON_ROWS.replace('AS c', 'AS y')} GROUP BY ALL)"
_BESIDE = f"(SELECT x.p_partkey AS a, y.p_partkey AS b FROM part x JOIN part y ON y.p_partkey = x.p_partkey + 1)"
_KMER_MEAN = "(SELECT vec_id, CAST(i AS INT) AS i, avg(embedding[CAST(i + w * 8 + 1 AS INT)]::DOUBLE) AS x FROM embeddings, range(0, 24) AS a(i), range(0, 6) AS b(w) GROUP BY ALL)"
_GRAMS3 = f"(SELECT substr(aa_seq, CAST(i AS INT), 3) AS gram, count(*) AS n FROM (SELECT *, unnest(range(1, length(aa_seq) - 1)) AS i FROM {_AA}) GROUP BY 1)"
_ADJUSTED = f"(SELECT p_partkey, -abs(price - 1200) AS p, -size AS s, price, size FROM {_coded()})"


def _pairs(pairs: str) -> str:
    """SQL for a, b, code of pairs of keys: mutations of both by position, the targets of a shared one in the order of the pair."""
    return f"""WITH p AS ({pairs}), m AS (SELECT * FROM {_MUTS}),
            u AS (SELECT a, b, pos, src, targ, 0 AS side FROM p JOIN m ON p_partkey = a UNION ALL SELECT a, b, pos, src, targ, 1 FROM p JOIN m ON p_partkey = b),
            g AS (SELECT a, b, pos, min(src) AS src, string_agg(targ, '' ORDER BY side) AS targ FROM u GROUP BY a, b, pos)
            SELECT a, b, coalesce(string_agg(src || (pos + 1) || targ, '_' ORDER BY pos), '') AS code FROM p LEFT JOIN g USING (a, b) GROUP BY a, b"""


def _library_hits(cutoff: float = 90.0) -> str:
    """Windows that hold one of a tag's seeds, compared with the tag."""
    rows = made_library()
    kind = lambda n: {"Fusion": "fusion", "Leader": "leader", "Cleavage": "cleavage"}.get(n.split("-")[1], "purification")
    listed = ", ".join(f"({i}, '{n}', '{t}', '{kind(n)}')" for i, (n, t) in enumerate(rows))
    seeds = ", ".join(f"({i}, {a}, '{t[a:b]}')" for i, (_, t) in enumerate(rows) for a, b in seeds_of(len(t), most_mismatches(len(t), cutoff)))
    sizes = sorted({b - a for _, t in rows for a, b in seeds_of(len(t), most_mismatches(len(t), cutoff))})
    return f"""(WITH lib AS (SELECT * FROM (VALUES {listed}) AS l(place, name, tag, type)), seeds AS (SELECT * FROM (VALUES {seeds}) AS s(place, skip, seed)),
        docs AS MATERIALIZED (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN tag ELSE '' END || aa_seq || CASE WHEN doc_id % 2 = 0 THEN regexp_replace(tag, '(.{{11}}).', '\\1A', 'g') ELSE '' END AS s
                 FROM {_AA} JOIN lib ON place = doc_id % 150),
        chars AS (SELECT doc_id, s, CAST(unnest(range(1, length(s) + 1)) AS INT) AS i FROM docs),
        met AS ({" UNION ALL ".join(f"SELECT doc_id, place, i - 1 - skip AS start FROM chars JOIN seeds ON substr(s, i, {k}) = seed WHERE length(seed) = {k}" for k in sizes)}),
        near AS (SELECT DISTINCT doc_id, place, start FROM met)
        SELECT doc_id, place, name, CAST(start AS INT) AS start, round_even(100.0 * (length(tag) - hamming(substr(s, CAST(start AS INT) + 1, length(tag)), tag)) / length(tag), 2) AS identity
        FROM near JOIN docs USING (doc_id) JOIN lib USING (place)
        WHERE start >= 0 AND start + length(tag) <= length(s) AND length(tag) < length(s) AND (type <> 'fusion' OR length(s) - length(tag) >= 25))"""


def permutation_sql(numbers: str, n: str, seed: int, times: int = 1) -> str:
    """(x, place) of the numbers of a query with one column ``x``: the keyed permutation, a step of the walk in each turn of a recursion."""
    inner = f"(SELECT x, k, y // b AS l, y % b AS r, a, b, n FROM walk, size WHERE k < {times})"
    for i, (p, q, s) in enumerate(round_keys(seed)):
        f = f"(((r * {p} + {q}) % {MODULUS}) * ((r * {p} + {q}) % {MODULUS}) + {s}) % {MODULUS}"
        inner = f"(SELECT x, k, r AS l, (l + {f}) % {'b' if i % 2 else 'a'} AS r, a, b, n FROM {inner})"
    return f"""(WITH RECURSIVE n AS (SELECT CAST(({n}) AS BIGINT) AS n), sides AS (SELECT n, CAST(floor(sqrt(n - 1)) AS BIGINT) + 1 AS a FROM n), size AS (SELECT n, a, -(-n // a) AS b0, (n + a - 1) // a AS b FROM sides),
        walk AS (SELECT CAST(x AS BIGINT) AS x, CAST(x AS BIGINT) AS y, 0 AS k FROM ({numbers})
                 UNION ALL SELECT x, l * b + r AS y, CASE WHEN l * b + r < n THEN k + 1 ELSE k END AS k FROM {inner})
        SELECT x, y AS place FROM walk, size WHERE k = {times} AND y < n)"""


def oracle_sql() -> dict[str, str]:
    z = lambda x: f"({x} - avg({x}) OVER ()) / stddev_pop({x}) OVER ()"
    return {
        "null_mask_counts": "SELECT count(*) FILTER (lang = 'en') AS lang, count(*) FILTER (source = 'src0') AS source, count(*) FILTER (n_chars = 0) AS n FROM documents",
        "integrity_report": f"SELECT 'aa_seq has missing values and there is no aa_mut' AS problem WHERE EXISTS (SELECT * FROM {_AA} WHERE aa_seq = '') UNION ALL SELECT 'no target column'",
        "index_column": 'SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS "index" FROM documents',
        "target_zscore": f"SELECT o_orderkey, round({z('o_totalprice')}, 6) + 0.0 AS z FROM orders",
        "target_dezscore": "SELECT o_orderkey, round(o_totalprice * 2 + 3, 6) + 0.0 AS mean, round(o_totalprice / 2 * 2, 6) + 0.0 AS std FROM orders",
        "target_matrix": f"SELECT round({z('p_retailprice')}, 6) + 0.0 AS z FROM part",
        "target_adjust_max": f"SELECT p_partkey, round(p, 6) + 0.0 AS price, round(s, 6) + 0.0 AS size FROM {_ADJUSTED}",
        "summary_variable": f"SELECT p_partkey, round(2 * {z('p')} + 0.5 * {z('s')}, 6) + 0.0 AS summary FROM {_ADJUSTED}",
        "summary_variable_default": f"SELECT p_partkey, round({z('price')} + {z('size')}, 6) + 0.0 AS summary FROM {_ADJUSTED}",
        "target_histogram": "SELECT CAST(least(floor((o_totalprice - lo) / ((hi - lo) / 50)), 49) AS INT) AS bin, count(*) AS n FROM orders, (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders) GROUP BY 1",
        "feature_concat": "SELECT vec_id, CAST(i - 1 AS INT) AS i, round(x, 6) + 0.0 AS x FROM (SELECT vec_id, unnest(list_concat([label::DOUBLE], embedding::DOUBLE[])) AS x, unnest(range(1, len(embedding) + 2)) AS i FROM embeddings)",
        "parse_mutations": f"SELECT p_partkey, CAST(pos AS INT) AS pos, src, targ FROM {_MUTS}",
        "non_parsed_rows": f"SELECT p_partkey, aa_mut FROM {_coded()} WHERE lower(trim(aa_mut)) IN ('wildtype (wt)', 'wildtype', '', 'wt', '-', 'none')",
        "parent_sketch": f"SELECT (SELECT count(DISTINCT pos) FROM {_MUTS}) AS n_positions, string_agg(coalesce(src, '*'), '' ORDER BY i) AS sketch FROM (SELECT unnest(range(0, (SELECT max(pos) + 1 FROM {_MUTS}))) AS i) LEFT JOIN (SELECT DISTINCT pos, src FROM {_MUTS}) ON pos = i",
        "parent_sequence": f"SELECT aa_seq FROM {_APPLIED} JOIN {_coded()} USING (p_partkey) WHERE contains(aa_mut, 'wildtype') OR contains(aa_mut, 'wt')",
        "estimate_offset": f"""WITH p AS (SELECT DISTINCT pos + {SHIFT} AS pos, src FROM {_MUTS}), s AS (SELECT min(pos) AS lo, max(pos) AS hi, count(*) AS n FROM p),
            w AS (SELECT lo, n, unnest(range(0, {len(PARENT)} - (hi - lo + 1) + 1)) AS w FROM s),
            c AS (SELECT w, lo, n, count(*) FILTER (substr('{PARENT}', CAST(pos - lo + w + 1 AS INT), 1) = src) AS matches FROM p, w GROUP BY ALL)
            SELECT CAST(w - lo AS INT) AS "offset", matches, round(matches / n, 6) + 0.0 AS matching_ratio, CAST(row_number() OVER (ORDER BY matches DESC, w DESC) AS INT) AS rank FROM c""",
        "apply_mutations": f"SELECT p_partkey, aa_seq FROM {_APPLIED}",
        "fill_missing": f"SELECT p_partkey, CASE WHEN p_partkey <> 1 AND p_partkey % 3 = 0 THEN 'GIVEN' ELSE aa_seq END AS aa_seq FROM {_APPLIED}",
        "extract_mutations": f"SELECT p_partkey, CAST(pos AS INT) AS pos, src, targ FROM {_MUTS} WHERE src <> targ",
        "mutation_codes": f"SELECT p_partkey, sa || (a + 1) || ta || '-' || sb || (b + 1) || tb AS code FROM {_coded()} WHERE p_partkey <> 1",
        "variant_pairs_cross": _pairs(f"SELECT x.p_partkey AS a, y.p_partkey AS b FROM part x, part y WHERE y.p_partkey IN {tuple(CROSSED)}"),
        "variant_pairs_within": _pairs(f"SELECT x.p_partkey AS a, y.p_partkey AS b FROM part x, part y WHERE x.p_partkey < y.p_partkey AND (x.p_partkey IN {tuple(PAIRED)} OR y.p_partkey IN {tuple(PAIRED)})"),
        "seq_length": f"SELECT doc_id, length(aa_seq) AS aa_len FROM {_AA}",
        "char_counts_1gram": f"SELECT doc_id, CAST(i AS INT) AS i, length(aa_seq) - length(replace(aa_seq, substr('{AA}', CAST(i AS INT) + 1, 1), '')) AS n FROM (SELECT *, unnest(range(0, 21)) AS i FROM {_AA})",
        "char_ngram_2": f"SELECT doc_id, substr(aa_seq, CAST(i AS INT), 2) AS gram, count(*) AS n FROM (SELECT *, unnest(range(1, length(aa_seq))) AS i FROM {_AA}) GROUP BY ALL",
        "one_hot": f"SELECT doc_id, CAST(i - 1 AS INT) AS pos, instr('{AA}', substr(aa_seq, CAST(i AS INT), 1)) AS symbol FROM (SELECT *, unnest(range(1, length(aa_seq) + 1)) AS i FROM {_AA})",
        "translate_dna": f"SELECT doc_id, trim(coalesce(list_aggregate(list_transform(range(0, length(dna_seq) // 3), lambda i: ({_CODONS})[substr(dna_seq, CAST(i * 3 + 1 AS INT), 3)]), 'string_agg', ''), ''), '*') AS aa_seq FROM {_DNA}",
        "sequence_types": f"""SELECT doc_id, kind, CASE WHEN length(s) > 0 AND length(s) % 3 = 0 AND NOT regexp_matches(s, '[^ACGTURYKMSWBDHVN.X]') AND length(regexp_replace(s, '[^ATGC]', '', 'g')) / length(s) > 0.99 THEN 'DNA'
            WHEN length(s) > 0 AND length(s) % 3 = 0 AND NOT regexp_matches(s, '[^ACGTURYKMSWBDHVN.X]') AND length(regexp_replace(s, '[^AUGC]', '', 'g')) / length(s) > 0.99 THEN 'RNA'
            WHEN NOT regexp_matches(s, '[^{AMINO}]') THEN 'Protein' WHEN NOT regexp_matches(s, '[^{AMINO}X]') THEN 'Ambiguous_Protein' ELSE 'Unknown' END AS type
            FROM (SELECT doc_id, 'aa' AS kind, aa_seq AS s FROM {_AA} UNION ALL SELECT doc_id, 'dna', dna_seq FROM {_DNA})""",
        "js_distances": f"SELECT doc_id, round(distance, 6) + 0.0 AS distance FROM {_JS}",
        "artificial_filter": f"SELECT doc_id FROM {_JS} WHERE distance <= 0.2 OR aa_seq LIKE 'M%'",
        "split_train_test_md5": f"SELECT k AS doc_id, CASE WHEN place < ceil(n * 0.2::DOUBLE) THEN 'test' ELSE 'train' END AS part FROM {_PLACE.format(key='doc_id', seed=42, table='documents')}",
        "split_kfold_md5": f"SELECT doc_id, fold FROM {_FOLDS}",
        "union_splits": f"SELECT fold, count(*) AS n, CAST(sum(doc_id) AS BIGINT) AS ids FROM {_FOLDS} WHERE fold IN ('split_1', 'split_6') GROUP BY 1",
        "kfold_train_test_sets": f"SELECT CAST(6 - i AS INT) AS choice, count(*) FILTER (fold = 'split_' || i) AS n_train, count(*) FILTER (fold <> 'split_' || i) AS n_test FROM {_FOLDS}, range(0, 7) AS r(i) GROUP BY i",
        "minibatches": f"SELECT k AS event_id, place // 64 AS batch_id FROM {_PLACE.format(key='event_id', seed=11, table='events')}",
        "graph_counts": f"SELECT conv_id, last::BIGINT + 1 AS atm_count, last::BIGINT + 1 AS bnd_count FROM {_TURNS}",
        "adjacency": f"SELECT conv_id, row, col FROM {_CELLS}",
        "adjacency_dense": f"SELECT conv_id, row, col FROM {_CELLS}",
        "incidence": f"SELECT conv_id, src AS node, edge, -1.0::DOUBLE AS v FROM {_EDGES} UNION ALL SELECT conv_id, dst, edge, 1.0 FROM {_EDGES} WHERE src <> dst",
        "adjacency_by_type": f"SELECT conv_id, t::INT AS type, count(*) FILTER (src % 2 = t) AS n FROM {_EDGES}, (VALUES (0), (1), (2)) AS v(t) GROUP BY ALL",
        "return_probabilities": f"""WITH RECURSIVE w AS MATERIALIZED (SELECT conv_id, row, col, sum(p) AS p FROM (SELECT conv_id, row, col, 0.5 / count(*) OVER (PARTITION BY conv_id, row) AS p FROM {_CELLS} UNION ALL SELECT conv_id, unnest(range(0, last + 1))::INT, unnest(range(0, last + 1))::INT, 0.5 FROM {_TURNS}) GROUP BY ALL),
            r AS (SELECT conv_id, row, col, p::DOUBLE AS p, -1 AS step FROM w
            UNION ALL SELECT r.conv_id, r.row, w.col, sum(r.p * w.p) AS p, r.step + 1 AS step FROM r JOIN w ON r.conv_id = w.conv_id AND r.col = w.row WHERE r.step < 99 GROUP BY r.conv_id, r.row, w.col, r.step)
            SELECT conv_id, row AS node, step, round(p, 6) + 0.0 AS p FROM r WHERE row = col AND step >= 0""",
        "linear_kernel": "SELECT e.vec_id AS a, f.vec_id AS b, round(list_dot_product(e.embedding::DOUBLE[], f.embedding::DOUBLE[]), 4) + 0.0 AS value FROM embeddings e, (SELECT min(vec_id) AS vec_id, arg_min(embedding, vec_id) AS embedding FROM embeddings GROUP BY label) f",
        "kmer_distinct": f"SELECT substr(aa_seq, CAST(i AS INT), 3) AS kmer, count(*) AS n FROM (SELECT *, unnest(range(1, length(aa_seq) - 1)) AS i FROM {_AA}) GROUP BY 1",
        "mean_embedding": "SELECT vec_id, CAST(i AS INT) AS i, round(avg(embedding[CAST(j * 8 + i + 1 AS INT)]::DOUBLE), 6) + 0.0 AS x FROM embeddings, range(0, 8) AS a(i), range(0, 8) AS b(j) GROUP BY ALL",
        "kmer_mean": "SELECT vec_id, CAST(i AS INT) AS i, round(avg(embedding[CAST(i + w * 8 + 1 AS INT)]::DOUBLE), 6) + 0.0 AS x FROM embeddings, range(0, 24) AS a(i), range(0, 6) AS b(w) GROUP BY ALL",
        "tag_hits": f"SELECT doc_id, name, start, identity FROM {_HITS} WHERE identity >= 80",
        "tag_nonredundant": f'SELECT doc_id, h.name AS name, h.s AS start, h.e AS "end" FROM {_KEPT}',
        "tag_locations": f'SELECT doc_id, name, s AS start, e AS "end", location FROM {_PLACED}',
        "tag_strip": f"SELECT doc_id, seq AS aa_seq, n_end, c_start, substr(seq, n_end + 1, greatest(c_start - n_end, 0)) AS stripped_seq, coalesce(names, '') AS removed_tags FROM {_ENDS} LEFT JOIN {_REMOVED} USING (doc_id)",
        "cleaning_summary": f"""SELECT sequences, with_tags, tags, n_terminal, c_terminal, CAST(round_even(100.0 * with_tags / sequences, 0) AS INT) AS tag_percent, CAST(round_even(100.0 * n_terminal / nullif(tags, 0), 0) AS INT) AS n_percent,
            CAST(round_even(100.0 * c_terminal / nullif(tags, 0), 0) AS INT) AS c_percent FROM (SELECT count(*) AS sequences, count(r.doc_id) AS with_tags, CAST(coalesce(sum(r.n), 0) AS BIGINT) AS tags, CAST(coalesce(sum(front), 0) AS BIGINT) AS n_terminal,
            CAST(coalesce(sum(r.n - front), 0) AS BIGINT) AS c_terminal FROM documents LEFT JOIN {_REMOVED} r USING (doc_id))""",
        "tag_summary": f"SELECT name, count(*) AS n_hits, count(DISTINCT doc_id) AS n_sequences, CAST(round_even(100.0 * count(DISTINCT doc_id) / (SELECT count(*) FROM documents), 0) AS INT) AS percent FROM {_HITS} WHERE identity >= 80 GROUP BY 1",
        "feature_slices": "SELECT vec_id, CAST(i - 1 AS INT) AS i, round(x, 6) + 0.0 AS x FROM (SELECT vec_id, unnest(list_concat(embedding::DOUBLE[], [label::DOUBLE])) AS x, unnest(range(1, len(embedding) + 2)) AS i FROM embeddings)",
        "missing_mask": "SELECT doc_id, lang = 'en' AS missing FROM documents",
        "extract_codes": f"SELECT p_partkey, CASE WHEN p_partkey = 1 THEN '' ELSE concat_ws('_', CASE WHEN sa <> ta THEN sa || (a + 1) || ta END, CASE WHEN sb <> tb THEN sb || (b + 1) || tb END) END AS code FROM {_coded()}",
        "offset_report": f"""WITH p AS (SELECT DISTINCT pos + {SHIFT} AS pos, src FROM {_MUTS}), s AS (SELECT min(pos) AS lo, max(pos) AS hi, count(*) AS n FROM p),
            w AS (SELECT lo, n, unnest(range(0, {len(PARENT)} - (hi - lo + 1) + 1)) AS w FROM s),
            c AS (SELECT w, lo, n, count(*) FILTER (substr('{ALTERED}', CAST(pos - lo + w + 1 AS INT), 1) = src) AS matches FROM p, w GROUP BY ALL),
            b AS (SELECT CAST(w - lo AS INT) AS off, round(matches / n, 6) + 0.0 AS matching_ratio FROM c ORDER BY matches DESC, w DESC LIMIT 1)
            SELECT off AS "offset", matching_ratio, CAST(pos + 1 AS INT) AS pos, src, substr('{ALTERED}', CAST(pos + off + 1 AS INT), 1) AS par FROM p, b WHERE substr('{ALTERED}', CAST(pos + off + 1 AS INT), 1) <> src""",
        "combine_variants": _pairs(f"SELECT * FROM {_BESIDE}"),
        "concat_mutations": f"""SELECT a, CAST(row_number() OVER (PARTITION BY a ORDER BY side, pos) - 1 AS INT) AS place, CAST(pos AS INT) AS pos, src, targ
            FROM (SELECT a, 0 AS side, pos, src, targ FROM {_BESIDE} p JOIN {_MUTS} m ON m.p_partkey = p.a UNION ALL SELECT a, 1, pos, src, targ FROM {_BESIDE} p JOIN {_MUTS} m ON m.p_partkey = p.b)""",
        "similarity_matrix": f"""SELECT 'neighbours' AS matrix, x.s AS row_sym, y.s AS col_sym, CAST(count(g.doc_id) AS DOUBLE) AS score
            FROM (SELECT unnest(string_split('{AA}', '')) AS s) x, (SELECT unnest(string_split('{AA}', '')) AS s) y
            LEFT JOIN (SELECT DISTINCT doc_id, substr(aa_seq, CAST(i AS INT), 2) AS gram FROM (SELECT *, unnest(range(1, length(aa_seq))) AS i FROM {_AA})) g ON g.gram = x.s || y.s GROUP BY 1, 2, 3""",
        "similarity_score": f"SELECT p_partkey, sum(score) AS score FROM (SELECT *, unnest(range(1, {len(PARENT)} + 1)) AS i FROM {_APPLIED}) JOIN {_SIMILAR} ON row_sym = substr(aa_seq, CAST(i AS INT), 1) AND col_sym = substr('{PARENT}', CAST(i AS INT), 1) GROUP BY 1",
        "ngram_range": f"SELECT p_partkey, substr(aa_seq, CAST(i AS INT), CAST(k AS INT)) AS gram, count(*) AS n FROM (SELECT *, unnest(range(1, length(aa_seq) - k + 2)) AS i FROM {_APPLIED}, range(1, 4) AS r(k)) GROUP BY ALL",
        "one_hot_padding": f"SELECT p_partkey, CAST(i AS INT) AS pos, CASE WHEN i <= p_size THEN instr('{AA}', substr('{PARENT}', CAST(i + 1 AS INT), 1)) ELSE 0 END AS symbol FROM part, range(0, {len(PARENT)}) AS r(i)",
        "minibatch_features": f"SELECT k AS vec_id, place // 32 AS batch_id, round(embedding[1]::DOUBLE, 6) + 0.0 AS first, round(embedding[-1]::DOUBLE, 6) + 0.0 AS last, label::DOUBLE AS target FROM {_PLACE.format(key='vec_id', seed=42 + 1_000_003, table='embeddings')} JOIN embeddings ON vec_id = k",
        "incidence_by_type": f"""WITH e AS (SELECT conv_id, src, dst, CAST(1 - src % 2 AS INT) AS type, CAST(row_number() OVER (PARTITION BY conv_id, src % 2 ORDER BY edge) - 1 AS INT) AS edge FROM {_EDGES})
            SELECT conv_id, type, src AS node, edge, -1.0::DOUBLE AS v FROM e UNION ALL SELECT conv_id, type, dst, edge, 1.0 FROM e WHERE src <> dst""",
        "kmer_mean_unit": f"SELECT vec_id, i, round(x / sqrt(sum(x * x) OVER (PARTITION BY vec_id)), 6) + 0.0 AS x FROM {_KMER_MEAN}",
        "kmer_centers": """WITH w AS (SELECT DISTINCT embedding[CAST(w * 8 + 1 AS INT):CAST(w * 8 + 24 AS INT)]::DOUBLE[] AS v FROM embeddings, range(0, 6) AS r(w)), u AS (SELECT v, sqrt(list_dot_product(v, v)) AS n FROM w)
            SELECT round(v[1] / n, 6) + 0.0 AS first, round(v[24] / n, 6) + 0.0 AS last, count(*) AS n FROM u GROUP BY 1, 2""",
        "tag_conservation": f"""SELECT doc_id, name, start, round_even(100.0 * greatest(least(start + n, len - back) - greatest(start, front), 0) / n, 2) AS conservation
            FROM (SELECT *, CASE WHEN doc_id % 5 = 0 THEN 13 ELSE 0 END AS front, CASE WHEN doc_id % 7 = 0 THEN 8 ELSE 0 END AS back FROM {_HITS} WHERE identity >= 80)""",
        "tag_library_hits": f"SELECT * FROM {_library_hits()} WHERE identity >= 90",
        "vocabulary": f"SELECT gram, row_number() OVER (ORDER BY gram) - 1 AS id, n FROM {_GRAMS3}",
        "sparse_ngrams": f"""WITH v AS (SELECT gram, row_number() OVER (ORDER BY gram) - 1 AS id FROM {_GRAMS3})
            SELECT doc_id, (SELECT count(*) FROM v) AS size, id, count(*) AS n FROM (SELECT doc_id, substr(aa_seq, CAST(i AS INT), 3) AS gram FROM (SELECT *, unnest(range(1, length(aa_seq) - 1)) AS i FROM {_AA})) JOIN v USING (gram) GROUP BY ALL""",
        "permuted_splits": f"""SELECT x AS vec_id, place AS position, CASE WHEN place < ceil(n * 0.2::DOUBLE) THEN 'test' ELSE 'train' END AS part, 'split_' || least(place // (n // 7), 6) AS fold
            FROM {permutation_sql("SELECT vec_id AS x FROM embeddings", "SELECT count(*) FROM embeddings", 42)}, (SELECT count(*) AS n FROM embeddings)""",
        "minibatch_rows": f"""SELECT place // 32 AS batch_id, string_agg(CAST(vec_id AS VARCHAR), ',' ORDER BY place) AS ids, round(sum(list_sum(embedding::DOUBLE[])), 3) AS total, string_agg(CAST(label AS VARCHAR), ',' ORDER BY place) AS labels
            FROM {permutation_sql("SELECT vec_id AS x FROM embeddings", "SELECT count(*) FROM embeddings", 42, 2)} JOIN embeddings ON vec_id = x GROUP BY 1""",
        "sparse_return_probabilities": f"""WITH RECURSIVE w AS MATERIALIZED (SELECT conv_id, row, col, sum(p) AS p FROM (SELECT conv_id, row, col, 0.5 / count(*) OVER (PARTITION BY conv_id, row) AS p FROM {_CELLS} UNION ALL SELECT conv_id, unnest(range(0, last + 1))::INT, unnest(range(0, last + 1))::INT, 0.5 FROM {_TURNS}) GROUP BY ALL),
            r AS (SELECT conv_id, row, col, p::DOUBLE AS p, -1 AS step FROM w
            UNION ALL SELECT r.conv_id, r.row, w.col, sum(r.p * w.p) AS p, r.step + 1 AS step FROM r JOIN w ON r.conv_id = w.conv_id AND r.col = w.row WHERE r.step < 9 GROUP BY r.conv_id, r.row, w.col, r.step)
            SELECT conv_id, row AS node, step, round(p, 6) + 0.0 AS p FROM r WHERE row = col AND step >= 0""",
        "offsets_on_parents": f"""WITH m AS (SELECT DISTINCT pos, src FROM {_MUTS}), s AS (SELECT min(pos) AS lo, max(pos) AS hi, count(DISTINCT pos) AS n FROM m),
            g AS (SELECT n_nationkey AS parent_id, substr('{PARENT}', n_nationkey % {len(PARENT)} + 1) || substr('{PARENT}', 1, n_nationkey % {len(PARENT)}) AS p FROM nation),
            w AS (SELECT parent_id, p, n, unnest(range(-lo, length(p) - hi)) AS off FROM g, s),
            c AS (SELECT parent_id, n, off, count(*) FILTER (substr(p, CAST(pos + off + 1 AS INT), 1) = src) AS matches FROM w, m GROUP BY ALL)
            SELECT parent_id, CAST(off AS INT) AS "offset", matches, round(matches / n, 6) + 0.0 AS matching_ratio, CAST(row_number() OVER (PARTITION BY parent_id ORDER BY matches DESC, off DESC) AS INT) AS rank FROM c""",
        "column_tags": " UNION ALL ".join(
            f"SELECT '{t}' AS name, '{p.tag}' AS tag WHERE " + (" AND " if p.whole else " OR ").join(f"(SELECT count(*) FROM (DESCRIBE {t}) WHERE contains(column_name, '{x}')) > 0" for x in p.patterns) for t in TABLES for p in COLUMN_TAGS
        ),
        "catalog_report": " UNION ALL ".join(
            f"SELECT '{t}' AS name, (SELECT count(*) FROM {t}) AS n_rows, (SELECT count(*) FROM (DESCRIBE {t})) AS n_columns, (SELECT string_agg(column_name, ',') FROM (DESCRIBE {t})) AS features" for t in TABLES
        ),
    }
