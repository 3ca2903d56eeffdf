"""The queries of `catalog` as DuckDB SQL, written out from plain SQL parts.

The parts are worded apart from the engine's expressions, and its patterns are
spelled out: they are what the engine's results are held against. Only the
fixed word lists are the same.
"""

from __future__ import annotations

from brandloom.functions.vocabulary import DEFAULT
from brandloom.operators.coverage import LEVEL_1
from brandloom.plans.adapters import LOOKUP_SQL, PAIRS_SQL, PRODUCTS_SQL, ROOTS_DUCKDB_SQL, WIDE_DUCKDB_SQL
from brandloom.plans.catalog import WIDE_BLOCK

STRENGTH = r"(?i)^\d+(\.\d+)?\s*(mg|g|mcg|ml|l|iu|%|w/w|w/v|meq)?/?(\d+(\.\d+)?\s*(mg|g|mcg|ml|l|iu|%)?)?$"
CLEANER_STRENGTH = r"(?i)^\d+(\.\d+)?\s*(mg|gm|g|mcg|ml|l|iu|au|miu|%|w/w|w/v|meq|lb)?/?(\d+(\.\d+)?\s*(mg|gm|g|mcg|ml|l|iu|au|miu|%|lb)?)?$"
GLUE = r"(\d[\d.]*)\s*(mg|gm|mcg|g|ml|l|iu|au|miu|%|lb)"
CHAIN = r"\b\d[\d.]*\s*(?:mg|gm|mcg|g|ml|l|iu|au|miu|%|lb)?(?:\s*/\s*\d[\d.]*\s*(?:mg|gm|mcg|g|ml|l|iu|au|miu|%|lb)?)+\b"


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _list(words) -> str:
    return "[" + ", ".join(_q(w) for w in sorted(words)) + "]"


def _kept(tokens: str, drops: str, least: int = 0) -> str:
    """tokens up to the last (t at i, from 1) for which `drops` is false."""
    return f"({tokens})[1 : list_max(list_prepend({least}, list_transform({tokens}, lambda t, i: CASE WHEN {drops} THEN 0 ELSE i END)))]"


def _tokens(s: str) -> str:
    return f"list_filter(string_split(trim(regexp_replace({s}, '\\s+', ' ', 'g')), ' '), lambda t: t <> '')"


def molecule(x: str, keep_salts: bool = False) -> str:
    plain = f"trim(regexp_replace(lower(coalesce({x}, '')), '[^a-z0-9\\-/+]+', ' ', 'g'))"
    base = plain
    if not keep_salts:
        cut = _kept(f"string_split({plain}, ' ')", f"list_contains({_list(DEFAULT.salts)}, t)", 1)
        base = f"CASE WHEN list_contains({_list(DEFAULT.protected)}, {plain}) THEN {plain} ELSE array_to_string({cut}, ' ') END"
    pairs = "MAP {" + ", ".join(f"{_q(a)}: {_q(b)}" for a, b in sorted(DEFAULT.spellings.items())) + "}"
    return f"coalesce({pairs}[({base})], ({base}))"


def strength(x: str) -> str:
    last = f"regexp_replace(coalesce(list_extract(regexp_extract_all({x}, '\\(([^)]*)\\)', 1), -1), ''), '\\s+', '', 'g')"
    return f"CASE WHEN regexp_matches({last}, {_q(STRENGTH)}) THEN lower({last}) ELSE '' END"


def cell(x: str, keep_salts: bool = False) -> str:
    name = f"regexp_replace({x}, '\\([^)]*\\)', ' ', 'g')"
    return f"CASE WHEN trim(coalesce({x}, '')) <> '' AND {molecule(name, keep_salts)} <> '' THEN {{'m': {molecule(name, keep_salts)}, 's': {strength(x)}}} END"


def root(x: str) -> str:
    s = f"replace(replace(trim(lower(coalesce({x}, ''))), 'sugar free', ' '), 'sugarfree', ' ')"
    s = f"regexp_replace(regexp_replace({s}, '\\(.*?\\)', ' ', 'g'), '[^a-z0-9\\s\\-/+.]', ' ', 'g')"
    cut = _kept(_tokens(s), f"list_contains({_list(DEFAULT.forms)}, t) OR regexp_matches(t, {_q(STRENGTH)})")
    return f"CASE WHEN len({cut}) = 0 THEN {s} ELSE array_to_string({cut}, ' ') END"


_WORK = """
p0 AS ({products}),
p1 AS (SELECT *, list_filter([{one}, {two}], lambda p: p IS NOT NULL) AS parts FROM p0 WHERE lower(trim(type)) = 'allopathy'),
parsed AS (
  SELECT row_id, name, short_composition1, short_composition2, type, Is_discontinued, manufacturer_name,
    list_transform(parts, lambda p: p.m) AS molecules, coalesce(array_to_string(list_sort(list_transform(parts, lambda p: p.m)), ' + '), '') AS mol_sig,
    coalesce(array_to_string(list_transform(list_sort(parts), lambda p: p.m || '@' || p.s), ' + '), '') AS full_sig, len(parts) AS n_molecules, {root} AS brand_root
  FROM p1
), work AS (SELECT * FROM parsed WHERE n_molecules > 0)"""


def _work(keep_salts: bool = False) -> str:
    return "WITH " + _WORK.format(products=PRODUCTS_SQL, one=cell("short_composition1", keep_salts), two=cell("short_composition2", keep_salts), root=root("name"))


WORK = _work()
INVENTORY = WORK + """, inventory AS (
  SELECT molecule, count(*) AS product_count, arg_min(name, row_id) AS example_brand FROM (SELECT row_id, name, unnest(molecules) AS molecule FROM work) GROUP BY molecule
)"""
SUMMARY = WORK + """, summary AS (
  SELECT brand_root, count(*) AS n_products, count(DISTINCT mol_sig) AS n_distinct_molecule_sets, count(DISTINCT full_sig) AS n_distinct_full_sigs FROM work GROUP BY brand_root
)"""
DETAIL = SUMMARY + """, detail AS (
  SELECT w.brand_root, any_value(s.n_distinct_molecule_sets) AS n_distinct_molecule_sets, mol_sig AS composition, count(*) AS n_products,
    arg_min_null(name, row_id) AS example_name, arg_min_null(manufacturer_name, row_id) AS example_manufacturer
  FROM work w JOIN summary s USING (brand_root) WHERE s.n_distinct_molecule_sets >= 2 GROUP BY w.brand_root, mol_sig
)"""

_SOFT = "(list_contains({words}, {t}) OR regexp_matches({t}, {strength}))"


def clean(x: str) -> str:
    s = f"regexp_replace(trim(lower(coalesce({x}, ''))), '\\(.*?\\)', ' ', 'g')"
    s = f"regexp_replace({s}, {_q(GLUE)}, '\\1\\2', 'g')"
    s = f"regexp_replace({s}, {_q(CHAIN)}, ' ', 'g')"
    s = f"regexp_replace({s}, '[^a-z0-9\\s\\-/+.]', ' ', 'g')"
    words = _list({*DEFAULT.forms, *DEFAULT.more_forms, *DEFAULT.modifiers})
    soft = lambda t: _SOFT.format(words=words, t=t, strength=_q(CLEANER_STRENGTH))
    tokens = _tokens(s)
    before = f"coalesce(({tokens})[i - 1], '')"
    drops = f"{soft('t')} OR (i > 1 AND (regexp_matches(t, '[0-9]') OR (regexp_matches(t, '^[a-z]{{1,2}}$') AND ({soft(before)} OR regexp_matches({before}, '[0-9]')))))"
    cut = _kept(tokens, drops)
    return f"CASE WHEN len({cut}) = 0 THEN {s} ELSE array_to_string({cut}, ' ') END"


CLEANED = f"""WITH r AS (SELECT DISTINCT name AS before FROM ({PRODUCTS_SQL})),
cleaned AS (SELECT before, {clean('before')} AS clean_root FROM r),
kept AS (SELECT *, len(regexp_replace(lower(clean_root), '[^a-z]', '', 'g')) >= 3 AS keep FROM cleaned)"""

def _numbered(roots: str) -> str:
    return f"WITH roots AS (SELECT min(row_id) AS id, brand_root AS root FROM ({roots}) GROUP BY brand_root)"


NUMBERED = _numbered(ROOTS_DUCKDB_SQL)


def _soundex(s: str) -> str:
    digits = f"translate({s}, 'aeiouybfpvcgjkqsxzdtlmnr', '000000111122222222334556')"
    digits = f"(left({s}, 1) || regexp_replace(substr({s}, 2), '[hw]', '', 'g'))"
    coded = f"translate({digits}, 'aeiouyhwbfpvcgjkqsxzdtlmnr', '00000000111122222222334556')"
    for d in "0123456":
        coded = f"regexp_replace({coded}, '{d}+', '{d}', 'g')"
    return f"left(upper(left({s}, 1)) || replace(substr({coded}, 2), '0', '') || '000', 4)"


_KEYS = f""", s AS (SELECT id, s FROM (SELECT id, regexp_replace(lower(root), '[^a-z]', '', 'g') AS s FROM roots) WHERE len(s) >= 2), keys AS (
  SELECT id, 'soundex' AS pass, {_soundex('s')} AS key FROM s
  UNION ALL SELECT id, 'prefix4', left(s, 4) FROM s
  UNION ALL SELECT id, 'suffix4', right(s, 4) || '#' || (len(s) // 3)::VARCHAR FROM s
  UNION ALL SELECT id, 'suffix4', right(s, 4) || '#' || (len(s) // 3 + 1)::VARCHAR FROM s
  UNION ALL SELECT id, 'del1', left(s, k - 1) || substr(s, k + 1) FROM (SELECT id, s, unnest(range(1, len(s) + 1)) AS k FROM s WHERE len(s) BETWEEN 3 AND 14)
), blocks AS (SELECT pass, key, count(*) AS size FROM keys GROUP BY pass, key)"""
KEYS = NUMBERED + _KEYS


def _pairs(limit: int = 0, self_pairs: bool = False) -> str:
    held = f"SELECT pass, key, id, count(*) AS times FROM keys JOIN blocks USING (pass, key) {f'WHERE size <= {limit}' if limit else ''} GROUP BY pass, key, id"
    own = " UNION SELECT id, id FROM held WHERE times >= 2" if self_pairs else ""
    return f", held AS ({held}), pairs AS (SELECT DISTINCT a.id AS id_a, b.id AS id_b FROM held a JOIN held b ON a.pass = b.pass AND a.key = b.key AND a.id < b.id{own})"


_NAMED = ", named AS (SELECT a.root AS root_a, b.root AS root_b FROM pairs JOIN roots a ON a.id = id_a JOIN roots b ON b.id = id_b)"
_SCORED = """, scored AS (
  SELECT root_a, root_b, round(jaro_winkler_similarity(root_a, root_b), 4) AS jw, round(1 - levenshtein(root_a, root_b) / greatest(len(root_a), len(root_b)), 4) AS edit_sim FROM named WHERE root_a <> root_b
)"""
PAIRS = KEYS + _pairs()
NAMED = PAIRS + _NAMED
SCORED = NAMED + _SCORED
WIDE = _numbered(WIDE_DUCKDB_SQL) + _KEYS
WIDE_SCORED = WIDE + _pairs(WIDE_BLOCK) + _NAMED + _SCORED
GIVEN = f"WITH named AS (SELECT DISTINCT coalesce(root_a, '') AS root_a, coalesce(root_b, '') AS root_b FROM ({PAIRS_SQL}))" + _SCORED
TOP50 = " SELECT root_a, root_b, jw, edit_sim, round(0.4 * jw::DOUBLE + 0.6 * edit_sim::DOUBLE, 4) AS score FROM scored ORDER BY 0.4 * jw::DOUBLE + 0.6 * edit_sim::DOUBLE DESC, root_a, root_b LIMIT 50"


def _block_stats(limit: int = 0) -> str:
    return _pairs(limit, True) + f""" SELECT n_roots, candidates, non_singleton_blocks, largest_block, median_block, skipped_blocks, n_roots * (n_roots - 1) // 2 AS all_pairs,
            round(100 * (1 - candidates / (n_roots * (n_roots - 1) // 2)), 6) AS reduction_pct, round(2 * candidates / n_roots, 4) AS per_root
            FROM (SELECT count(*) AS n_roots FROM roots), (SELECT count(*) AS candidates FROM pairs),
            (SELECT count(*) AS non_singleton_blocks, max(size) AS largest_block, quantile_disc(size, 0.5) AS median_block, {f'count(*) FILTER (size > {limit})' if limit else '0::BIGINT'} AS skipped_blocks FROM blocks WHERE size > 1)"""


PROBES = "(VALUES ('the', 'then'), ('the', 'nowhere'), ('ing', 'tion'), ('er', 'ers'), ('that', 'this')) AS known(root_a, root_b)"

_LOOKED_UP = f""", l0 AS (SELECT word, rxcui, match_method, CASE WHEN codes = '' THEN [] ELSE string_split(codes, '|') END AS c, CASE WHEN names = '' THEN [] ELSE string_split(names, '|') END AS n FROM {LOOKUP_SQL}),
l1 AS (SELECT word, rxcui, match_method, list_filter(range(1, len(c) + 1), lambda i: list_position(c, c[i]) = i) AS firsts, c, n FROM l0),
l2 AS (SELECT word, rxcui, match_method, list_transform(firsts, lambda i: c[i]) AS c, list_transform(firsts, lambda i: n[i]) AS n FROM l1)"""


def _mapping(molecules: str = "inventory", unknown: str = "not_attempted") -> str:
    return INVENTORY + _LOOKED_UP + f""", mapping AS (
  SELECT molecule, product_count, rxcui, coalesce(match_method, '{unknown}') AS match_method, coalesce(len(c), 0)::BIGINT AS n_atc_codes, coalesce(array_to_string(c, ';'), '') AS atc_codes,
    coalesce(array_to_string(n, ';'), '') AS atc_names, coalesce(array_to_string(list_sort(list_distinct(list_transform(c, lambda x: left(x, 1)))), ';'), '') AS atc_level1
  FROM {molecules} LEFT JOIN l2 ON word = split_part(molecule, ' ', 1)
)"""


MAPPING = _mapping()
COVERAGE = """ SELECT *, round(100.0 * with_rxcui / greatest(attempted, 1), 4) AS rxcui_pct, round(100.0 * with_atc / greatest(attempted, 1), 4) AS atc_pct, round(100.0 * products_covered / greatest(products, 1), 4) AS molecule_weighted_pct
            FROM (SELECT count(*) AS attempted, count(rxcui) AS with_rxcui, count(*) FILTER (n_atc_codes > 0) AS with_atc, count(*) FILTER (match_method = 'exact') AS exact, count(*) FILTER (starts_with(match_method, 'approx')) AS approximate,
            coalesce(sum(product_count), 0)::BIGINT AS products, coalesce(sum(product_count) FILTER (n_atc_codes > 0), 0)::BIGINT AS products_covered FROM mapping{where})"""
# Published codes by Metaphone, Double Metaphone (primary) and NYSIIS.
VECTORS = {
    "metaphone": {"catherine": "K0RN", "katherine": "K0RN", "peter": "PTR", "phone": "FN", "robert": "RBRT", "smith": "SM0", "thumb": "0M", "wright": "RT"},
    "dmeta": {"catherine": "K0RN", "michael": "MKL", "peter": "PTR", "phone": "FN", "robert": "RPRT", "schmidt": "XMT", "school": "SKL", "smith": "SM0", "thomas": "TMS", "thumb": "0M", "wright": "RT"},
    "nysiis": {"catherine": "CATARAN", "katherine": "CATARAN", "knight": "NAGT", "macintosh": "MCANT", "peter": "PATAR", "robert": "RABAD", "smith": "SNAT", "thompson": "TANPSAN"},
}


_LABELS = "(VALUES " + ", ".join(f"({_q(k)}, {_q(v)})" for k, v in LEVEL_1.items()) + ") AS labels(code, label)"
_PRODUCT_COLUMNS = "row_id, name, short_composition1, short_composition2, type, Is_discontinued, manufacturer_name, array_to_string(molecules, '|') AS molecules, mol_sig, full_sig, n_molecules, brand_root"


def oracle_sql() -> dict[str, str]:
    return {
        "load_stats": f"SELECT count(*) AS n_rows, 'name,short_composition1,short_composition2,type,Is_discontinued,manufacturer_name' AS columns FROM ({PRODUCTS_SQL})",
        "filter_stats": f"SELECT kept, before, discontinued, round(100.0 * kept / greatest(before, 1), 4) AS kept_pct FROM (SELECT count(*) FILTER (lower(trim(type)) = 'allopathy') AS kept, count(*) AS before, count(*) FILTER (lower(trim(type)) = 'allopathy' AND Is_discontinued = 'TRUE') AS discontinued FROM ({PRODUCTS_SQL}))",
        "parse_products": WORK + f" SELECT {_PRODUCT_COLUMNS} FROM parsed",
        "parse_products_keep_salts": _work(True) + f" SELECT {_PRODUCT_COLUMNS} FROM parsed",
        "parse_failures": WORK + " SELECT name, short_composition1, short_composition2 FROM parsed WHERE n_molecules = 0",
        "parse_stats": WORK + " SELECT count(*) FILTER (n_molecules > 0) AS parsed_ok, round(100.0 * count(*) FILTER (n_molecules > 0) / greatest(count(*), 1), 4) AS parsed_pct, count(*) FILTER (n_molecules = 0) AS failures, count(*) FILTER (n_molecules = 1) AS single, count(*) FILTER (n_molecules = 2) AS double FROM parsed",
        "molecule_inventory": INVENTORY + " SELECT * FROM inventory",
        "top_molecules": INVENTORY + " SELECT * FROM inventory ORDER BY product_count DESC, molecule LIMIT 10",
        "brand_root_summary": SUMMARY + " SELECT * FROM summary",
        "brand_roots_export": WORK + " SELECT brand_root, count(*) AS n_products, array_to_string(list_sort(list(DISTINCT mol_sig)), ' | ') AS compositions FROM work GROUP BY brand_root",
        "collisions_molecule": DETAIL + " SELECT * FROM detail",
        "collisions_strength": SUMMARY + " SELECT * FROM summary WHERE n_distinct_molecule_sets = 1 AND n_distinct_full_sigs >= 2",
        "collision_headline": SUMMARY + " SELECT n_roots, molecule_roots, products_involved, strength_roots, round(100.0 * molecule_roots / greatest(n_roots, 1), 4) AS molecule_roots_pct FROM (SELECT count(*) AS n_roots, count(*) FILTER (n_distinct_molecule_sets >= 2) AS molecule_roots, coalesce(sum(n_products) FILTER (n_distinct_molecule_sets >= 2), 0)::BIGINT AS products_involved, count(*) FILTER (n_distinct_molecule_sets = 1 AND n_distinct_full_sigs >= 2) AS strength_roots FROM summary)",
        "worst_roots_top15": SUMMARY + """, top AS (SELECT * FROM summary WHERE n_distinct_molecule_sets >= 2 ORDER BY n_distinct_molecule_sets DESC, brand_root LIMIT 15),
            f AS (SELECT brand_root, mol_sig, min(row_id) AS seen FROM work WHERE brand_root IN (SELECT brand_root FROM top) GROUP BY ALL),
            g AS (SELECT brand_root, list(mol_sig ORDER BY seen) AS sigs FROM f GROUP BY brand_root)
            SELECT brand_root, n_distinct_molecule_sets, n_products, array_to_string(sigs[1:5], ' | ') AS compositions, greatest(len(sigs) - 5, 0) AS n_more FROM top JOIN g USING (brand_root)""",
        "namespace_shape": WORK + " SELECT count(DISTINCT mol_sig) AS n_compositions, count(DISTINCT brand_root) AS n_roots, round(count(DISTINCT brand_root) / greatest(count(DISTINCT mol_sig), 1), 4) AS roots_per_composition FROM work",
        "brands_per_composition_top10": WORK + " SELECT mol_sig, count(DISTINCT brand_root) AS n_brands FROM work GROUP BY mol_sig ORDER BY n_brands DESC, mol_sig LIMIT 10",
        "clean_roots": CLEANED + " SELECT DISTINCT clean_root AS brand_root FROM kept WHERE keep",
        "clean_root_stats": CLEANED + """ SELECT n_rows, changed, round(100.0 * changed / greatest(n_rows, 1), 4) AS changed_pct, dropped, distinct_before, distinct_after, distinct_before - distinct_after AS fewer
            FROM (SELECT count(*) AS n_rows, count(*) FILTER (clean_root <> before) AS changed, count(*) FILTER (NOT keep) AS dropped, count(DISTINCT before) AS distinct_before, count(DISTINCT clean_root) FILTER (keep) AS distinct_after FROM kept)""",
        "short_root_histogram": NUMBERED + " SELECT len(root) < 4 AS is_short, count(DISTINCT root) AS n_roots FROM roots GROUP BY 1",
        "short_roots_first40": NUMBERED + " SELECT root AS brand_root FROM roots WHERE len(root) < 4 ORDER BY id, root LIMIT 40",
        "tiny_roots": NUMBERED + " SELECT root AS brand_root, root AS composition, root AS example_name FROM roots WHERE len(root) <= 2",
        "tiny_root_stats": NUMBERED + " SELECT count(DISTINCT root) AS n_roots, count(*) AS n_rows FROM roots WHERE len(root) <= 2",
        "block_keys_native": KEYS + " SELECT * FROM keys",
        "candidate_pairs_native": NAMED + " SELECT * FROM named",
        "candidate_pairs_self": KEYS + _pairs(0, True) + " SELECT * FROM pairs",
        "candidate_pairs_maxblock": KEYS + _pairs(12) + " SELECT * FROM pairs",
        "pass_contribution": KEYS + " SELECT pass, coalesce(sum(size * (size - 1) // 2) FILTER (size >= 2), 0)::BIGINT AS pairs FROM blocks GROUP BY pass",
        "block_stats": KEYS + _block_stats(),
        "block_stats_maxblock": KEYS + _block_stats(12),
        "pass_contribution_maxblock": KEYS + " SELECT pass, coalesce(sum(size * (size - 1) // 2) FILTER (size BETWEEN 2 AND 12), 0)::BIGINT AS pairs FROM blocks GROUP BY pass",
        "recall_total": PAIRS + f" SELECT count(id_a) AS kept, count(*) AS known FROM {PROBES} LEFT JOIN roots a ON a.root = root_a LEFT JOIN roots b ON b.root = root_b LEFT JOIN pairs ON id_a = least(a.id, b.id) AND id_b = greatest(a.id, b.id) AND a.id IS NOT NULL AND b.id IS NOT NULL",
        "rank_top0": SCORED + " SELECT *, 0.0::DOUBLE AS score FROM scored LIMIT 0",
        "score_given_pairs": GIVEN + " SELECT * FROM scored",
        "pairs_round_trip": GIVEN + " SELECT * FROM scored",
        "scored_round_trip": SCORED + " SELECT * FROM scored",
        "phonetic_vectors": "SELECT * FROM (VALUES " + ", ".join(f"({_q(name)}, {_q(p)}, {_q(key)})" for p, codes in VECTORS.items() for name, key in codes.items()) + ") AS v(name, pass, key)",
        "wide_block_stats": WIDE + _block_stats(WIDE_BLOCK),
        "wide_scan_stats": WIDE_SCORED + " SELECT count(*) AS scanned, count(*) AS eligible FROM scored",
        "wide_rank_top50": WIDE_SCORED + TOP50,
        "csv_round_trip": WORK + f" SELECT {_PRODUCT_COLUMNS} FROM parsed",
        "conditional_sinks": WORK + " SELECT CASE WHEN k = 0 THEN 'failures: ' || CASE WHEN count(*) FILTER (n_molecules = 0) > 0 THEN 'True' ELSE 'False' END ELSE 'nothing: False' END AS value FROM parsed, (SELECT unnest([0, 1]) AS k) GROUP BY k",
        "cached_mapping": MAPPING + " SELECT * FROM mapping",
        "lookup_round_trip": MAPPING + " SELECT * FROM mapping",
        "enriched_mapping": _mapping(unknown="none") + " SELECT * FROM mapping",
        "lookup_missing": INVENTORY + f" SELECT * FROM inventory WHERE split_part(molecule, ' ', 1) NOT IN (SELECT word FROM {LOOKUP_SQL} WHERE match_method <> 'none')",
        "atc_mapping_top5": _mapping("(SELECT * FROM inventory ORDER BY product_count DESC, molecule LIMIT 5)") + " SELECT * FROM mapping",
        "atc_coverage_of_nothing": MAPPING + COVERAGE.format(where=" WHERE false"),
        "big_blocks_top8": KEYS + " SELECT * FROM blocks WHERE size > 10 ORDER BY size DESC, pass DESC, key DESC LIMIT 8",
        "recall_probe": PAIRS + f""" SELECT root_a, root_b, CASE WHEN a.id IS NULL OR b.id IS NULL THEN 'not in roots' WHEN id_a IS NOT NULL THEN 'kept' ELSE 'blocked apart' END AS outcome
            FROM {PROBES} LEFT JOIN roots a ON a.root = root_a LEFT JOIN roots b ON b.root = root_b LEFT JOIN pairs ON id_a = least(a.id, b.id) AND id_b = greatest(a.id, b.id)""",
        "score_pairs": SCORED + " SELECT * FROM scored",
        "rank_top50": SCORED + TOP50,
        "rank_no_digits": SCORED + " SELECT root_a, root_b, jw, edit_sim, round(0.3 * jw::DOUBLE + 0.7 * edit_sim::DOUBLE, 4) AS score FROM scored WHERE NOT regexp_matches(root_a || root_b, '[0-9]') ORDER BY 0.3 * jw::DOUBLE + 0.7 * edit_sim::DOUBLE DESC, root_a, root_b LIMIT 20",
        "scan_stats": SCORED + " SELECT count(*) AS scanned, count(*) FILTER (NOT regexp_matches(root_a || root_b, '[0-9]')) AS eligible FROM scored",
        "atc_mapping": MAPPING + " SELECT * FROM mapping",
        "atc_unmapped": MAPPING + " SELECT * FROM mapping WHERE n_atc_codes = 0",
        "atc_unmapped_top20": MAPPING + " SELECT molecule, product_count FROM mapping WHERE n_atc_codes = 0 ORDER BY product_count DESC, molecule LIMIT 20",
        "atc_coverage": MAPPING + COVERAGE.format(where=""),
        "atc_level1_histogram": MAPPING + f" SELECT c.code, count(*) AS n, coalesce(any_value(label), '') AS label FROM (SELECT unnest(string_split(atc_level1, ';')) AS code FROM mapping WHERE n_atc_codes > 0) c LEFT JOIN {_LABELS} ON labels.code = c.code GROUP BY c.code",
    }
