"""Queries: prescription text, scans, privacy."""

import uuid

from pyspark.sql import functions as F

from vitalgrid.functions import rx_fixed as fx
from vitalgrid.operators.rx import dictionary, items as it, lines as ln, post, scans
from vitalgrid.plans.registry import query
from vitalgrid.session import checkpoint_dir
from vitalgrid.sources import files

RX = ["rx_items", "rx_lines", "prescriptions"]
SLOT = "CASE slot WHEN 0 THEN 'Sáng' WHEN 1 THEN 'Trưa' ELSE 'Tối' END"
ITEM_LINE = "CAST(no AS VARCHAR) || '. ' || p_name || ' ' || CAST(p_size * 10 AS VARCHAR) || 'mg'"
NAME = "p_name || ' ' || CAST(p_size * 10 AS VARCHAR) || ' mg'"
# Documents with the usual misreadings: carriage returns, doubled blanks, unaccented and misread times of day.
NOISY = """SELECT doc_id, replace(replace(replace(replace(text, chr(10), chr(13) || chr(10)), ' ', '  '), 'Sáng', 'sang'), 'Tối', 'T6i') AS text FROM prescriptions"""
READ = f"""SELECT i.doc_id, i.no, i.dose, i.slot, p.p_name, p.p_size, ROW_NUMBER() OVER (PARTITION BY i.doc_id ORDER BY i.no) AS rn FROM rx_items i JOIN part p ON p.p_partkey = i.partkey"""
SPOKEN = "CASE slot WHEN 0 THEN 'sáng' WHEN 1 THEN 'Trưa' ELSE 'tối' END"
# Every second line of the split text is empty, as it ends in carriage return and line feed.
LINES = f"""SELECT doc_id, CAST(4 * (rn - 1) AS INT) AS line_no, {ITEM_LINE} AS line, TRUE AS item, no, rn FROM read_items
 UNION ALL SELECT doc_id, CAST(4 * (rn - 1) + 2 AS INT), {SPOKEN} || ' ' || CAST(dose AS VARCHAR) || ' viên', FALSE, no, rn FROM read_items"""
STEPS = [("read_items", READ), ("text_lines", LINES)]


def noisy(ds):
    return ds.sql(NOISY, ["prescriptions"])


def read_items(ds):
    return ds.sql(READ, ["rx_items"])


@query("normalize_lines", "SELECT doc_id, line_no, line FROM text_lines", RX, STEPS)
def normalize_lines(ds):
    return ln.normalize_lines(noisy(ds))


@query(
    "marker_sequence",
    """SELECT doc_id, COUNT(*) AS n_markers, COUNT(*) >= 2 AND MIN(no) = 1 AND MAX(no) <= COUNT(*) + 3
  AND COUNT(*) FILTER (WHERE step BETWEEN 1 AND 2) >= GREATEST(1, COUNT(*) - 2) AS reliable
 FROM (SELECT doc_id, no, no - LAG(no) OVER (PARTITION BY doc_id ORDER BY no) AS step FROM read_items) GROUP BY doc_id""",
    RX,
    STEPS,
)
def marker_sequence(ds):
    return ln.marker_sequence(ln.line_groups(ln.normalize_lines(noisy(ds))))


@query(
    "extract_fields",
    f"""SELECT doc_id, no, CAST(dose AS VARCHAR) || ' viên' AS dosage, CAST(p_size * 10 AS VARCHAR) || 'mg' AS strength, CAST(1 AS INT) AS times_per_day,
 CASE slot WHEN 0 THEN '08:00' WHEN 1 THEN '12:00' ELSE '20:00' END AS clocks,
 'Cách dùng: không rõ' || chr(10) || 'Giờ dùng: ' || lower({SLOT}) || chr(10) || 'Ngày uống: 1 lần' AS instructions FROM read_items""",
    RX,
    STEPS,
)
def extract_fields(ds):
    blocks = ds.sql("SELECT doc_id, no, line AS block FROM rx_lines", ["rx_lines"])
    return it.extract_fields(blocks).select(
        "doc_id", "no", "dosage", "strength", "times_per_day", F.array_join("specific_times", ",").alias("clocks"), "instructions"
    )


@query("clean_names", f"SELECT doc_id, no, {NAME} AS name FROM read_items", RX, STEPS)
def clean_names(ds):
    rows = ds.sql("SELECT doc_id, no, line AS raw, line AS block FROM rx_lines", ["rx_lines"])
    return it.clean_names(rows).select("doc_id", "no", "name")


CONFIDENT = f"""SELECT doc_id, no, CASE WHEN no % 2 = 0 THEN p_name ELSE {NAME} || '?' END AS name, CASE WHEN no % 3 = 0 THEN 'Theo đơn' ELSE '1 viên' END AS dosage FROM read_items"""


@query(
    "item_confidence",
    """SELECT doc_id, no, ROUND(0.45 + CASE WHEN length(name) >= 10 THEN 0.15 ELSE 0 END + 0.10 + CASE WHEN no % 3 = 0 THEN 0 ELSE 0.15 END + 0.10
 - CASE WHEN no % 2 = 0 THEN 0 ELSE 0.10 END, 3)::DOUBLE AS confidence FROM named""",
    RX,
    [*STEPS, ("named", CONFIDENT)],
)
def item_confidence(ds):
    rows = ds.sql(CONFIDENT.replace("AS VARCHAR)", "AS STRING)"), ["rx_items"], [("read_items", READ)])
    return it.item_confidence(rows.withColumn("specific_times", F.array(F.lit("08:00")))).select("doc_id", "no", "confidence")


# A name needs a word of four letters.
WORDY = "GREATEST(length(split_part(p_name, ' ', 1)), length(split_part(p_name, ' ', 2))) >= 4"
NAMED = f"""SELECT doc_id, CAST(no AS INT) AS pos, CASE WHEN no % 3 = 0 THEN p_name ELSE {NAME} END AS name, CAST(0.5 + 0.1 * (no % 2) AS DOUBLE) AS confidence, {WORDY} AS wordy FROM read_items"""


def named(ds):
    return ds.sql(NAMED.replace("AS VARCHAR)", "AS STRING)"), ["rx_items"], [("read_items", READ)]).drop("wordy")


@query("plausible_items", "SELECT doc_id, pos, name, confidence FROM named WHERE name LIKE '% mg' AND wordy", RX, [*STEPS, ("named", NAMED)])
def plausible_items(ds):
    return it.plausible_items(named(ds))


@query(
    "best_items",
    """SELECT doc_id, first_pos AS pos, name, confidence FROM (SELECT *, MIN(pos) OVER (PARTITION BY doc_id, name) AS first_pos,
 ROW_NUMBER() OVER (PARTITION BY doc_id, name ORDER BY confidence DESC, length(name) DESC, pos) AS rn FROM named WHERE name LIKE '% mg' AND wordy) WHERE rn = 1""",
    RX,
    [*STEPS, ("named", NAMED)],
)
def best_items(ds):
    return it.best_items(named(ds)).select("doc_id", "pos", "name", "confidence")


@query(
    "parse_head_items",
    f"SELECT doc_id, MIN(no) AS pos, {NAME} AS name, 'Theo đơn' AS dosage, CAST(0.8 AS DOUBLE) AS confidence FROM read_items WHERE {WORDY} GROUP BY doc_id, {NAME}",
    RX,
    STEPS,
)
def parse_head_items(ds):
    return it.parse_head_items(ln.normalize_lines(noisy(ds))).select("doc_id", "pos", "name", "dosage", "confidence")


@query(
    "parse_numbered_items",
    f"""SELECT doc_id, no AS pos, {NAME} AS name, CAST(dose AS VARCHAR) || ' viên' AS dosage, CAST(0.95 AS DOUBLE) AS confidence FROM read_items WHERE {WORDY}
 QUALIFY ROW_NUMBER() OVER (PARTITION BY doc_id, {NAME} ORDER BY no) = 1""",
    RX,
    STEPS,
)
def parse_numbered_items(ds):
    out = it.parse_numbered_items(ln.line_groups(ln.normalize_lines(noisy(ds))))
    return out.select("doc_id", "pos", "name", "dosage", "confidence")


COUNTS = """SELECT o_orderkey AS doc_id, o_orderkey % 4 AS block, o_custkey % 5 AS numbered, o_orderkey % 3 AS head, o_custkey % 7 AS relaxed,
 o_orderkey % 2 = 0 AS reliable, 50 + o_orderkey % 1000 AS n_chars FROM orders"""


@query(
    "choose_strategy",
    """SELECT doc_id, CASE WHEN (size = 0 AND n_chars >= 120 AND relaxed > 0) OR (size BETWEEN 1 AND 2 AND n_chars >= 650 AND relaxed > size) THEN 'relaxed' ELSE base END AS strategy FROM
 (SELECT *, CASE base WHEN 'numbered' THEN numbered WHEN 'numbered_head' THEN head WHEN 'block' THEN block ELSE 0 END AS size FROM
  (SELECT *, CASE WHEN reliable AND head >= 2 THEN CASE WHEN numbered > head THEN 'numbered' ELSE 'numbered_head' END WHEN reliable AND numbered >= 2 THEN 'numbered'
    WHEN block > 0 THEN 'block' ELSE 'none' END AS base FROM counts))""",
    [],
    [("counts", COUNTS)],
)
def choose_strategy(ds):
    return it.choose_strategy(ds.sql(COUNTS))


JSON_DOCS = """SELECT o_orderkey AS doc_id, CASE o_orderkey % 6
 WHEN 0 THEN '{"items":[{"name":" ' || o_orderpriority || ' ","dosage":"2 viên","times_per_day":"3"},"bad",null,{"dosage":"x"}]}'
 WHEN 1 THEN '```json' || chr(10) || '[{"drug_name":"' || o_orderpriority || '","confidence":0.5}]' || chr(10) || '```'
 WHEN 2 THEN '{"items":"no list","don_thuoc":[{"name":"","ten_thuoc":"' || o_orderpriority || '","lieu":"1 gói","tan_suat":2}]}'
 WHEN 3 THEN 'Paracetamol 500mg' WHEN 4 THEN '{"broken":' ELSE '{"meta":[{"name":"x"}]}' END AS text FROM orders"""


@query(
    "parse_json_docs",
    """SELECT doc_id, CAST(0 AS INT) AS pos, o_orderpriority AS name, CASE doc_id % 6 WHEN 0 THEN '2 viên' WHEN 1 THEN '1 liều' ELSE '1 gói' END AS dosage,
 CAST(CASE doc_id % 6 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS INT) AS times_per_day, CAST(CASE doc_id % 6 WHEN 1 THEN 0.5 ELSE 0.8 END AS DOUBLE) AS confidence
 FROM (SELECT o_orderkey AS doc_id, o_orderpriority FROM orders) WHERE doc_id % 6 < 3""",
)
def parse_json_docs(ds):
    return it.parse_json_docs(ds.sql(JSON_DOCS)).select("doc_id", "pos", "name", "dosage", "times_per_day", "confidence")


SURFACE = """SELECT doc_id, CAST(no AS INT) AS pos, CASE no % 4 WHEN 0 THEN '/ ' || p_name || ' 450mg Sáng 2 viên' WHEN 1 THEN p_name || ' | gói 3' WHEN 2 THEN p_name || ' 300mg (URSODEOXYCHOLIC ACID)'
 ELSE 'omeprazol ' || p_name || ' MT (' END AS name FROM read_items"""


@query(
    "surface_names",
    """SELECT doc_id, CAST(no AS INT) AS pos, CASE WHEN no % 4 = 2 THEN 'URSODEOXYCHOLIC ACID' WHEN no % 4 = 3 THEN 'Omeprazole ' || p_name
 WHEN length(split_part(p_name, ' ', 1)) <= 4 THEN replace(p_name, ' ', '') ELSE p_name END AS name FROM read_items""",
    RX,
    STEPS,
)
def surface_names(ds):
    return post.surface_names(ds.sql(SURFACE, ["rx_items"], [("read_items", READ)])).drop("raw_name")


QUALITY = """SELECT doc_id, CAST(no AS INT) AS pos, p_name, CAST(0.9 AS DOUBLE) AS confidence, CASE no % 7 WHEN 0 THEN 'ngày uo' WHEN 1 THEN p_name || ')Glumet' WHEN 2 THEN 'a/b|c/d' WHEN 3 THEN 'ab1'
 WHEN 4 THEN p_name || ' (' ELSE p_name END AS name, CASE WHEN no % 7 = 5 THEN 'not_found' WHEN no % 7 = 6 THEN 'fuzzy_below_cutoff' ELSE 'exact' END AS name_match_kind FROM read_items"""


@query(
    "name_quality",
    """SELECT doc_id, pos, CASE pos % 7 WHEN 1 THEN p_name WHEN 4 THEN p_name ELSE name END AS name, CASE pos % 7 WHEN 1 THEN 'glued_names' WHEN 2 THEN 'high_symbol_density' WHEN 3 THEN 'too_few_letters'
  WHEN 4 THEN 'dangling_bracket' ELSE '' END AS reason, CASE WHEN pos % 7 BETWEEN 1 AND 4 THEN 0.495 ELSE 0.9 END::DOUBLE AS confidence, TRUE AS review_needed,
 CASE pos % 7 WHEN 6 THEN 'Tên thuốc ''' || name || ''' gần đúng nhưng chưa đủ chắc chắn, cần kiểm tra thủ công'
  ELSE 'Tên thuốc có độ tin cậy thấp, cần kiểm tra lại đơn gốc: ''' || CASE pos % 7 WHEN 1 THEN p_name WHEN 4 THEN p_name ELSE name END || '''' END AS warnings
 FROM judged WHERE pos % 7 <> 0""",
    RX,
    [*STEPS, ("judged", QUALITY)],
)
def name_quality(ds):
    rows = ds.sql(QUALITY, ["rx_items"], [("read_items", READ)])
    out = post.name_quality(rows.withColumn("raw_name", F.col("name")).withColumn("cleaned", F.col("name")))
    return out.select(
        "doc_id", "pos", "name", "reason", "confidence", "review_needed", F.array_join("warnings", ";").alias("warnings")
    )


LISTED = """SELECT doc_id, CAST(no AS INT) AS pos, CASE no % 3 WHEN 0 THEN p_name WHEN 1 THEN upper(p_name) || ' forte' ELSE split_part(p_name, ' ', 2) END AS name FROM read_items"""


def listed(ds):
    return ds.sql(LISTED, ["rx_items"], [("read_items", READ)])


@query(
    "drop_duplicate_names",
    "SELECT doc_id, MIN(pos) AS pos, ARG_MIN(name, pos) AS name FROM listed GROUP BY doc_id, replace(lower(name), ' ', '')",
    RX,
    [*STEPS, ("listed", LISTED)],
)
def drop_duplicate_names(ds):
    return post.drop_duplicate_names(listed(ds)).select("doc_id", "pos", "name")


@query(
    "drop_subsumed_names",
    """SELECT doc_id, pos, name FROM listed a WHERE NOT EXISTS (SELECT 1 FROM listed b WHERE b.doc_id = a.doc_id
 AND list_has_all(string_split(lower(b.name), ' '), string_split(lower(a.name), ' ')) AND len(string_split(b.name, ' ')) > len(string_split(a.name, ' ')))""",
    RX,
    [*STEPS, ("listed", LISTED)],
)
def drop_subsumed_names(ds):
    return post.drop_subsumed_names(listed(ds))


HINTED = """SELECT p_partkey AS doc_id, CAST(0 AS INT) AS pos, CASE p_partkey % 5 WHEN 0 THEN 'Augmentin 625' WHEN 1 THEN 'ASPIRIN + ibuprofen' WHEN 2 THEN 'Mixtard, codeine' WHEN 3 THEN p_name ELSE 'amoxicillin/insulin ' || p_name END AS name FROM part"""


@query(
    "allergy_hints",
    """SELECT p_partkey AS doc_id, CASE p_partkey % 5 WHEN 0 THEN 'Penicillin' WHEN 1 THEN 'Aspirin,Ibuprofen' WHEN 2 THEN 'Codeine,Morphine,Insulin' WHEN 3 THEN '' ELSE 'Penicillin,Insulin' END AS hints FROM part""",
)
def allergy_hints(ds):
    return post.allergy_hints(ds.sql(HINTED)).select("doc_id", F.array_join("allergy_hints", ",").alias("hints"))


SPARSE = """SELECT doc_id, text || CASE doc_id % 4 WHEN 0 THEN ' Losartan 50, paracelamol, calci va vitamin' WHEN 1 THEN ' Xarelto; metformin; crestor; norvasc; atorva; bisoprol; sucralf' ELSE '' END AS text FROM documents"""


@query(
    "rescue_known",
    f"""SELECT doc_id, name, CAST(0.43 AS DOUBLE) AS confidence FROM (SELECT s.doc_id, k.name, ROW_NUMBER() OVER (PARTITION BY s.doc_id ORDER BY k.no) AS rn FROM sparse s
 JOIN (VALUES {", ".join(f"({i}, '{p}', '{n}')" for i, (_, p, n) in enumerate(fx.RESCUES))}) k(no, pattern, name) ON regexp_matches(lower(s.text), k.pattern)
 WHERE length(s.text) >= 500) WHERE rn <= 6""",
    [],
    [("sparse", SPARSE)],
)
def rescue_known(ds):
    none = ds.spark.createDataFrame(
        [],
        "doc_id bigint, pos int, name string, dosage string, strength string, instructions string, "
        "times_per_day int, specific_times array<string>, confidence double",
    )
    return post.rescue_known(ds.sql(SPARSE), none).select("doc_id", "name", "confidence")


TOTALS = """SELECT doc_id, text || CASE doc_id % 4 WHEN 0 THEN chr(10) || 'Cộng khoản: ' || CAST(doc_id % 40 AS VARCHAR(4)) WHEN 1 THEN chr(10) || 'CONG KHOAN 7' ELSE '' END AS text FROM documents"""


@query(
    "expected_count",
    """SELECT doc_id, CAST(CASE WHEN doc_id % 4 = 0 AND doc_id % 40 BETWEEN 1 AND 30 THEN doc_id % 40 WHEN doc_id % 4 = 1 THEN 7 END AS INT) AS expected FROM documents""",
)
def expected_count(ds):
    return ln.expected_count(ds.sql(TOTALS))


REPORT_ITEMS = """SELECT doc_id, CAST(0.4 + 0.1 * no AS DOUBLE) AS confidence FROM rx_items WHERE doc_id % 5 <> 0"""
REPORT_WARNINGS = """SELECT doc_id, no, 'w' || CAST(dose AS VARCHAR(3)) AS warning FROM rx_items"""


@query(
    "document_report",
    """SELECT d.doc_id, COALESCE(i.n, 0) AS items_count, COALESCE(i.c, 0)::DOUBLE AS avg_confidence,
 CASE WHEN COALESCE(i.c, 0) < 0.7 THEN 'Cần kiểm tra lại đơn thuốc;' ELSE '' END || w.ws AS warnings
FROM (SELECT DISTINCT doc_id FROM rx_items) d LEFT JOIN (SELECT doc_id, COUNT(*) AS n, ROUND(AVG(confidence), 3) AS c FROM ri GROUP BY doc_id) i USING (doc_id)
JOIN (SELECT doc_id, STRING_AGG(warning, ';' ORDER BY no) AS ws FROM (SELECT doc_id, warning, MIN(no) AS no FROM rw GROUP BY doc_id, warning) GROUP BY doc_id) w USING (doc_id)""",
    ["rx_items"],
    [("ri", REPORT_ITEMS), ("rw", REPORT_WARNINGS)],
)
def document_report(ds):
    docs = ds.sql("SELECT DISTINCT doc_id FROM rx_items", ["rx_items"])
    out = post.document_report(ds.sql(REPORT_ITEMS, ["rx_items"]), ds.sql(REPORT_WARNINGS, ["rx_items"]), docs)
    return out.withColumn("warnings", F.array_join("warnings", ";"))


# Four passes of each page; two misread l as 1.
PASSES = """SELECT doc_id, p.p AS pass, CAST(no AS INT) AS line_no, CASE WHEN p.k >= 2 THEN replace(line, 'l', '1') ELSE line END ||
 CASE WHEN p.k = 1 AND no % 3 = 0 THEN ' ' || CAST(doc_id AS VARCHAR(20)) ELSE '' END AS line
 FROM rx_lines JOIN (VALUES (0, 'enhanced'), (1, 'deskewed'), (2, 'adaptive'), (3, 'soft')) p(k, p) ON p.k >= 0 WHERE p.k > 0 OR no % 4 <> 1"""


@query(
    "merge_passes",
    """SELECT doc_id, CAST(ROW_NUMBER() OVER (PARTITION BY doc_id ORDER BY extra, k, line_no) - 1 AS INT) AS pos, line FROM
 (SELECT doc_id, FALSE AS extra, 0 AS k, line_no, line FROM passes WHERE pass = 'enhanced'
  UNION ALL SELECT doc_id, TRUE, 1, line_no, line FROM passes x WHERE pass = 'deskewed' AND NOT EXISTS (SELECT 1 FROM passes b WHERE b.doc_id = x.doc_id AND b.pass = 'enhanced' AND b.line = x.line) AND regexp_matches(line, '[A-Za-zÀ-ỹ]{5,}')
  UNION ALL SELECT doc_id, TRUE, 2, line_no, line FROM passes x WHERE pass = 'adaptive' AND line_no % 3 = 0 AND line_no % 4 = 1 AND regexp_matches(line, '[A-Za-zÀ-ỹ]{5,}'))""",
    ["rx_lines"],
    [("passes", PASSES)],
)
def merge_passes(ds):
    lines = ds.sql(PASSES, ["rx_lines"])
    base = lines.select("doc_id").distinct().withColumn("pass", F.lit("enhanced"))
    return scans.merge_passes(lines, base)


SCORED = """SELECT doc_id, p.p AS pass, CAST(0.5 + 0.05 * ((doc_id + p.k) % 3) AS DOUBLE) AS conf, CASE WHEN (doc_id + p.k) % 3 = 0 THEN text || ' ' || text ELSE text END AS text
 FROM documents JOIN (VALUES (0, 'enhanced'), (1, 'deskewed'), (2, 'adaptive'), (3, 'soft')) p(k, p) ON p.k >= 0"""


@query(
    "best_pass",
    """SELECT doc_id, pass, conf, length(text) AS n FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY doc_id ORDER BY conf + LEAST(length(text), 1500) / 4000.0::DOUBLE DESC,
 CASE pass WHEN 'enhanced' THEN 0 WHEN 'deskewed' THEN 1 WHEN 'adaptive' THEN 2 ELSE 3 END) AS rn FROM scored) WHERE rn = 1""",
    [],
    [("scored", SCORED)],
)
def best_pass(ds):
    return scans.best_pass(ds.sql(SCORED)).select("doc_id", "pass", "conf", F.length("text").cast("bigint").alias("n"))


BOXES = """SELECT doc_id, CAST(no AS INT) AS box_no, CAST((no * 37) % 11 AS DOUBLE) AS y, CASE WHEN no = 3 THEN '  ' ELSE line END AS text, CAST(0.25 * (no % 4) AS DOUBLE) AS conf FROM rx_lines"""


@query(
    "reading_order",
    """SELECT doc_id, STRING_AGG(text, chr(10) ORDER BY y, box_no) AS text, ROUND(AVG(conf), 6) AS confidence FROM boxes WHERE trim(text) <> '' GROUP BY doc_id""",
    ["rx_lines"],
    [("boxes", BOXES)],
)
def reading_order(ds):
    boxes = ds.sql(BOXES, ["rx_lines"]).withColumn(
        "points",
        F.array(*[F.array(F.lit(x), F.col("y") + F.lit(d)) for x, d in ((0.0, 0.0), (9.0, 0.0), (9.0, 2.0), (0.0, 2.0))]),
    )
    return scans.reading_order(boxes).withColumn("confidence", F.round("confidence", 6))


# The second reading of a document is the next document's text; every fifth has none.
TEXTS = """SELECT d.doc_id, d.text AS primary_text, s.text AS secondary_text, CAST((d.doc_id % 10) / 10.0 AS DOUBLE) AS score
 FROM documents d LEFT JOIN documents s ON s.doc_id = d.doc_id + 1 AND d.doc_id % 5 <> 0"""


@query(
    "choose_text",
    """SELECT doc_id, CASE WHEN take THEN secondary_text ELSE primary_text END AS text, CASE WHEN take THEN GREATEST(score, 0.5) ELSE score END AS score, take AS used_fallback
 FROM (SELECT *, (length(primary_text) < 120 OR score < 0.45) AND COALESCE(length(secondary_text), 0) > length(primary_text) AS take FROM texts)""",
    [],
    [("texts", TEXTS)],
)
def choose_text(ds):
    return scans.choose_text(ds.sql(TEXTS))


MARKED = """SELECT doc_id, '# Scan 7' || chr(10) || 'so  phieu' || chr(10) || '- 2 viên **' || CAST(doc_id AS VARCHAR(20)) || '**' || chr(10) ||
 CASE WHEN doc_id % 2 = 0 THEN '## Đơn thuốc' ELSE 'khác' END || chr(10) || '| tên | ghi chú |' || chr(10) || 'barcode 12' AS text FROM documents"""


@query(
    "clean_markdown",
    """SELECT doc_id, '2 viên ' || CAST(doc_id AS VARCHAR) || CASE WHEN doc_id % 2 = 0 THEN chr(10) || 'Đơn thuốc' || chr(10) || 'tên ghi chú' ELSE '' END AS text FROM documents""",
)
def clean_markdown(ds):
    return scans.clean_markdown(ds.sql(MARKED))


# Whole texts under a heading and bullets; of three documents one has the prescription header, one dosing words in every line.
# A null and an empty text come on top.
MARKED_TEXTS = """SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN '# Scan 7' || chr(10) || '## Đơn thuốc' || chr(10) || '- ' || replace(text, chr(10), chr(10) || '- ')
 WHEN 1 THEN '# Scan 7' || chr(10) || '> **' || replace(text, chr(10), '**' || chr(10) || '> **') || '**'
 ELSE '# Scan 7' || chr(10) || '| ' || replace(text, chr(10), ' | 2 viên |' || chr(10) || '| ') || ' | 2 viên |' END AS text FROM documents
 UNION ALL SELECT CAST(-1 AS BIGINT), nullif('', '') UNION ALL SELECT CAST(-2 AS BIGINT), ''"""
BLANK = r"[\t-\r \x{85}\p{Z}]"
WORD_SIGN = r"\p{L}\p{M}\p{Nd}\p{Nl}\p{Pc}"
BREAKS = r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x{85}\x{2028}\x{2029}]"


def plain_word(words):
    return f"(?i)(?:^|[^{WORD_SIGN}])(?:{words})(?:[^{WORD_SIGN}]|$)"


BARE = f"""regexp_replace(regexp_replace(replace(regexp_replace(regexp_replace(s, '^(?:[#>*-]|{BLANK})+', ''), '[*][*](.*?)[*][*]', '\\1', 'g'), '|', ' '), '{BLANK}+', ' ', 'g'), '^[ :;-]+|[ :;-]+$', '', 'g')"""
IS_HEADER = f"regexp_matches(s, '{plain_word('đơn thuốc|toa thuốc')}')"
IS_NOISE = f"""regexp_matches(s, '(?i)^(?:#+|[*_`>-]+)$|^{BLANK}*(?:thông tin|scan|barcode|mã đơn|ms|số phiếu|địa chỉ|dt)(?:[^{WORD_SIGN}]|$)')"""
IS_ITEM = f"""(regexp_matches(s, '^{BLANK}*(?:\\p{{Nd}}{{1,2}}{BLANK}*[)./-]|[-*])') OR regexp_matches(s, '{plain_word('mg|mcg|g|ml|viên|goi|gói|ống|sáng|trưa|chiều|tối|uống')}'))"""
MARKED_LINES = f"""SELECT doc_id, list_filter(list_transform(regexp_split_to_array(COALESCE(text, ''), '{BREAKS}'), lambda s: regexp_replace(s, '^{BLANK}+|{BLANK}+$', '', 'g')), lambda s: s <> '') AS ls FROM marked"""
MARKED_BARE = f"""SELECT doc_id, ls, bs, list_position(list_transform(bs, lambda s: {IS_HEADER}), TRUE) AS head FROM
 (SELECT doc_id, ls, list_filter(list_transform(ls, lambda s: {BARE}), lambda s: s <> '') AS bs FROM marked_lines)"""


@query(
    "clean_markdown_texts",
    f"""SELECT doc_id, COALESCE(regexp_replace(array_to_string(CASE WHEN len(ks) > 0 THEN ks ELSE list_transform(ls, lambda s: regexp_replace(s, '{BLANK}+', ' ', 'g')) END, chr(10)), '^{BLANK}+|{BLANK}+$', '', 'g'), '') AS text FROM
 (SELECT doc_id, ls, list_filter(bs, lambda s, i: {IS_HEADER} OR (NOT {IS_NOISE} AND (COALESCE(i > head, FALSE) OR {IS_ITEM}))) AS ks FROM marked_bare)""",
    [],
    [("marked", MARKED_TEXTS), ("marked_lines", MARKED_LINES), ("marked_bare", MARKED_BARE)],
)
def clean_markdown_texts(ds):
    """Every whole document text, marked up, cleaned."""
    return scans.clean_markdown(ds.sql(MARKED_TEXTS))


EDGE = r"(?:[^0-9A-Za-z_À-ỹ]|$)"
SCRUB_SQL = (
    "CASE WHEN regexp_matches(s, '"
    + "(?i)"
    + fx.PERSONAL_LINE.replace(r"\bhoten\b", "hoten").removesuffix(r"\b")
    + EDGE
    + "') THEN '[Đã che thông tin cá nhân]' ELSE regexp_replace(regexp_replace(regexp_replace(s, '(?i)"
    + fx.EMAIL
    + "', '[EMAIL_REDACTED]', 'g'), '"
    + fx.PHONE
    + "', '[PHONE_REDACTED]', 'g'), '"
    + fx.LONG_DIGITS
    + "', '[ID_REDACTED]', 'g') END"
)
# Every document gains a phone line and a labelled line.
PRIVATE = """SELECT doc_id, text || chr(10) || 'goi 0912345678 hoac a.b@c.vn' || chr(10) || CASE WHEN doc_id % 2 = 0 THEN 'Họ tên: Nguyen' ELSE 'Ho ten khong' END AS text FROM documents"""
SCRUBBED = f"""SELECT doc_id, STRING_AGG({SCRUB_SQL}, chr(10) ORDER BY i) AS text FROM
 (SELECT doc_id, i, regexp_replace(part, '^\\s+|\\s+$', '', 'g') AS s FROM (SELECT doc_id, UNNEST(regexp_split_to_array(text, '\\r\\n|[\\n\\r]')) AS part, generate_subscripts(regexp_split_to_array(text, '\\r\\n|[\\n\\r]'), 1) AS i FROM private))
 WHERE s <> '' GROUP BY doc_id"""


@query("scrub_pii", SCRUBBED, [], [("private", PRIVATE)])
def scrub_pii(ds):
    return scans.scrub_pii(ds.sql(PRIVATE))


SAID = "SELECT conv_id, turn, role, text || chr(10) || 'xin goi 0912345678 ' || role AS text FROM conversations"
SAID_LINES = SCRUBBED.replace("doc_id", "conv_id, turn, role").replace("FROM private", "FROM said")


@query(
    "scrub_payloads",
    """SELECT conv_id, turn, '[REDACTED]' AS phone, CASE WHEN turn % 2 = 0 THEN '[REDACTED]' ELSE role END AS who, role AS note, text FROM cleaned""",
    [],
    [("said", SAID), ("cleaned", SAID_LINES)],
)
def scrub_payloads(ds):
    rows = ds.sql(SAID).select(
        "conv_id",
        "turn",
        F.create_map(
            F.lit("Phone"), F.lit("123"),
            F.when(F.col("turn") % 2 == 0, "patient_name").otherwise(F.lit("who")), F.col("role"),
            F.lit("note"), F.col("role"),
            F.lit("raw_text"), F.col("text"),
        ).alias("payload"),
    )
    out = scans.scrub_payloads(rows)
    p = F.col("payload")
    return out.select(
        "conv_id", "turn", p["Phone"].alias("phone"), F.coalesce(p["patient_name"], p["who"]).alias("who"),
        p["note"].alias("note"), p["raw_text"].alias("text"),
    )


def entries(ds):
    rows = ds.table("part").select(F.col("p_name").alias("Ten_Thuoc"), F.col("p_partkey").alias("row_no"))
    return dictionary.dictionary_entries(rows)


DRUGS = """SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN p_name || ' (' || p_brand || ')' WHEN 1 THEN ' ' || upper(p_name) || ' ' WHEN 2 THEN 'ab' ELSE p_name || '-' || CAST(p_size AS VARCHAR(4)) || ', "' || p_brand || '"' END AS drug_name, p_type AS other FROM part"""
# Three tables of parts, one after the other, each with its own name column; the last has none and is left out.
DRUG_FILES = [("p_partkey % 3 = 0", "\ufeffTen_Thuoc"), ("p_partkey % 3 = 1", " Drug_Name "), ("p_partkey % 3 = 2 AND p_partkey % 2 = 0", "thuoc"), ("p_partkey % 3 = 2 AND p_partkey % 2 = 1", "label")]


@query(
    "load_drug_dictionary",
    """SELECT key, ARG_MIN(name, length(name) * 10000000 + row_no) AS name, MIN(row_no) AS ord FROM (SELECT row_no, trim(drug_name) AS name,
 trim(regexp_replace(regexp_replace(lower(trim(drug_name)), '\\([^)]*\\)', ' ', 'g'), '[^a-z0-9]+', ' ', 'g')) AS key
 FROM (SELECT drug_name, ROW_NUMBER() OVER (ORDER BY p_partkey % 3, p_partkey) - 1 AS row_no FROM drugs WHERE p_partkey % 3 < 2 OR p_partkey % 2 = 0)) WHERE length(name) >= 3 AND length(key) >= 3 GROUP BY key""",
    [],
    [("drugs", DRUGS)],
)
def load_drug_dictionary(ds):
    """CSV files of four headers, one of them behind a byte order mark and one unknown, written in order of parts."""
    root = f"{checkpoint_dir(ds.spark).rstrip('/')}/drugs-{uuid.uuid4().hex}"
    drugs = ds.sql(DRUGS)
    for i, (keep, header) in enumerate(DRUG_FILES):
        # the columns change places from table to table
        columns = ["other", F.col("drug_name").alias(header)][:: 1 if i % 2 else -1]
        rows = drugs.filter(keep).orderBy("p_partkey").select(*columns)
        rows.write.csv(f"{root}/{i}", header=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    return dictionary.load_drug_dictionary(ds.spark, f"{root}/*")


# Names of every part in eight spellings; how each is found follows from how it was made. Letters added behind a
# name of n leave a ratio of 2n / (2n + added): one letter stays above the cutoff, a third of n falls below it.
ASKED = """SELECT DISTINCT p_name, p_partkey % 8 AS spelling, CASE p_partkey % 8 WHEN 0 THEN p_name WHEN 1 THEN p_name || ' 500mg' WHEN 2 THEN replace(p_name, 'e', 'é') WHEN 3 THEN ' ' || upper(p_name)
 WHEN 4 THEN p_name || 'q' WHEN 5 THEN p_name || repeat('q', CAST(ceil(length(p_name) / 3.0) AS INT)) WHEN 6 THEN p_type ELSE left(p_name, 2) END AS name FROM part"""


@query(
    "drug_match",
    """SELECT DISTINCT name, CASE WHEN spelling < 5 THEN p_name ELSE name END AS matched_name, CASE spelling WHEN 1 THEN 'exact_simplified'
 WHEN 2 THEN CASE WHEN contains(p_name, 'e') THEN 'exact_ascii' ELSE 'exact' END WHEN 4 THEN 'fuzzy' WHEN 5 THEN 'fuzzy_below_cutoff' WHEN 6 THEN 'not_found' WHEN 7 THEN 'name_too_short' ELSE 'exact' END AS name_match_kind FROM asked""",
    [],
    [("asked", ASKED)],
)
def drug_match(ds):
    """Part names as written, in capitals, with strengths, accents, one or several letters too many, unrelated and short ones."""
    return dictionary.drug_match(ds.sql(ASKED).select("name"), entries(ds))


UPLOADS = """SELECT doc_id, 'scan-' || CAST(doc_id AS VARCHAR(20)) AS path, CASE doc_id % 5 WHEN 0 THEN 'FFD8FFE0' WHEN 1 THEN '89504E47' WHEN 2 THEN '47494638' WHEN 3 THEN 'FF' ELSE '' END AS head FROM documents"""


@query(
    "image_intake_audit",
    """SELECT path, CASE doc_id % 5 WHEN 0 THEN 'ok' WHEN 1 THEN 'ok' WHEN 2 THEN 'unsupported_type' WHEN 3 THEN 'file_too_small' ELSE 'empty_file' END AS verdict FROM uploads""",
    [],
    [("uploads", UPLOADS)],
)
def image_intake_audit(ds):
    rows = ds.sql(UPLOADS).withColumn("content", F.unhex("head"))
    return files.image_intake_audit(rows.withColumn("length", F.length("content").cast("bigint"))).select("path", "verdict")


MAGIC = "CASE doc_id % 5 WHEN 0 THEN 'FFD8FFE0' WHEN 1 THEN '89504E47' WHEN 2 THEN '47494638' WHEN 3 THEN 'FF' ELSE '' END"
# A file over the limit, made of the first document's text.
TIMES = f"CAST(ceil({files.MAX_IMAGE_BYTES}.0 / (octet_length(%s) + 1)) AS INT)"
FILE_BYTES = f"""SELECT 'scan-' || CAST(doc_id AS VARCHAR) AS path, octet_length(encode(text)) + length({MAGIC}) // 2 AS length, left({MAGIC} || hex(encode(left(text, 4))), 8) AS head FROM documents
 UNION ALL SELECT 'scan-large', 4 + (octet_length(encode(text)) + 1) * {TIMES % "encode(text)"}, 'FFD8FFE0' FROM documents WHERE doc_id = (SELECT MIN(doc_id) FROM documents)
 UNION ALL SELECT 'scan-empty', 0, '' UNION ALL SELECT 'scan-small', 3, 'FFD8FF'"""


@query(
    "image_intake_texts",
    f"""SELECT path, CAST(length AS BIGINT) AS length, CASE WHEN length = 0 THEN 'empty_file' WHEN length < 4 THEN 'file_too_small' WHEN left(head, 4) <> 'FFD8' AND head <> '89504E47' THEN 'unsupported_type'
 WHEN length > {files.MAX_IMAGE_BYTES} THEN 'file_too_large' ELSE 'ok' END AS verdict FROM file_bytes""",
    [],
    [("file_bytes", FILE_BYTES)],
)
def image_intake_texts(ds):
    """Files of every whole document text behind a magic number, and a large, an empty and a short one."""
    docs = ds.table("documents").select("doc_id", "text")
    path = F.concat(F.lit("scan-"), F.col("doc_id").cast("string"))
    whole = docs.select(path.alias("path"), F.concat(F.unhex(F.expr(MAGIC)), F.encode("text", "utf-8")).alias("content"))
    large = docs.filter("text IS NOT NULL").orderBy("doc_id").limit(1).select(
        F.lit("scan-large").alias("path"),
        F.concat(F.unhex(F.lit("FFD8FFE0")), F.encode(F.expr(f"repeat(concat(text, 'x'), {TIMES % 'text'})"), "utf-8")).alias("content"),
    )
    others = ds.spark.range(2).selectExpr("IF(id = 0, 'scan-empty', 'scan-small') AS path", "unhex(IF(id = 0, '', 'FFD8FF')) AS content")
    uploads = whole.unionByName(large).unionByName(others)
    return files.image_intake_audit(uploads.withColumn("length", F.length("content").cast("bigint")))
