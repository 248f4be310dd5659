"""The operators over the sample tables, and the SQL that checks them where SQL can."""

from __future__ import annotations

from pyspark.sql import functions as F

from jobquarry.llm import ann, decontamination, jaccard_join, language_mixture, mixing, near_dedup, preference, repair, suffix_dedup, toxicity, url_filter, warc, whitening
from jobquarry.llm.frames import stored

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(function):
        QUERIES[name] = function
        if sql is not None:
            ORACLE[name] = sql
        return function

    return register


def table(spark, sf_dir: str, name: str):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op3_suffix_dedup")
def op3_suffix_dedup(spark, sf_dir):
    cleaned = suffix_dedup.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return cleaned.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


SETS_SQL = """
words AS (
  SELECT {key}, regexp_extract_all(translate({text}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                   '[^\\x20\\x09-\\x0D]+') AS w
  FROM {source}),
shingles AS (
  SELECT DISTINCT {key}, unnest(CASE WHEN len(w) >= 5
      THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
      WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s
  FROM words)"""


@query(
    "op7_near_dedup",
    "WITH RECURSIVE"
    + SETS_SQL.format(key="doc_id", text="text", source="documents")
    + """,
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
shared AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common
  FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (
  SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
  WHERE 100 * common >= 85 * (x.n + y.n - common)),
reach(doc_id, other) AS (
  SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, l.b FROM reach r JOIN links l ON l.a = r.other)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, m.component_id, m.component_id = d.doc_id AS kept
FROM documents d LEFT JOIN sizes USING (doc_id)
JOIN (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id) m ON m.doc_id = d.doc_id""",
)
def op7_near_dedup(spark, sf_dir):
    found = near_dedup.components(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_shingles", "component_id", "kept")


@query(
    "op9_mixing",
    """
WITH sized AS (
  SELECT doc_id, text, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size
  FROM documents),
sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         [5.0, 2.0, 1.0][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS INTEGER)]::DOUBLE AS weight
  FROM sized GROUP BY source),
levels AS (
  SELECT source, source_size, weight, 3.0::DOUBLE * source_size / weight AS full_at,
         (sum(source_size::DOUBLE) OVER () - coalesce(3.0::DOUBLE * sum(source_size::DOUBLE) OVER
            (ORDER BY 3.0::DOUBLE * source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / sum(weight) OVER (ORDER BY 3.0::DOUBLE * source_size / weight, source NULLS LAST
                             ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM sources),
targets AS (
  SELECT source, source_size, least(3.0::DOUBLE * source_size,
           weight * (SELECT level FROM levels WHERE full_at > level ORDER BY full_at, level LIMIT 1)) AS target
  FROM levels),
drawn AS (
  SELECT doc_id, size, source_size, target, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0 END AS rate,
         ('0x' || substr(md5('1|' || coalesce(CAST(doc_id AS VARCHAR), '') || '|' || md5(coalesce(text, ''))), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS draw
  FROM sized JOIN targets ON sized.source IS NOT DISTINCT FROM targets.source)
SELECT doc_id, size, source_size, target,
       CAST(size * (floor(rate) + CASE WHEN draw < rate - floor(rate) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM drawn""",
)
def op9_mixing(spark, sf_dir):
    taken = mixing.copies_of(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return taken.select(
        "row.doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).cast("long").alias("taken")
    )


@query(
    "op10_decontamination",
    "WITH"
    + SETS_SQL.format(key="doc_id", text="text", source="documents")
    + ","
    + SETS_SQL.format(key="item_id", text="text", source="benchmark").replace("words", "item_words").replace("shingles", "item_shingles")
    + """,
sizes AS (SELECT item_id, count(*) AS n_item FROM item_shingles GROUP BY item_id)
SELECT doc_id, item_id, count(*) AS n_shared, any_value(n_item) AS n_item, count(*) / any_value(n_item) AS containment
FROM shingles JOIN item_shingles USING (s) JOIN sizes USING (item_id)
GROUP BY doc_id, item_id HAVING 10 * count(*) >= 8 * any_value(n_item)""",
)
def op10_decontamination(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontamination.contained_items(docs, table(spark, sf_dir, "benchmark").select("item_id", "text"))
    return found.select("doc_id", "item_id", "n_shared", "n_item", "containment")


@query(
    "op4_warc",
    """
SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest,
       CASE WHEN octet_length(encode(coalesce(html, ''))) >= 100 AND page_id <> min(page_id) OVER (PARTITION BY coalesce(html, ''))
            THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN octet_length(encode(coalesce(html, ''))) >= 100 AND page_id <> min(page_id) OVER (PARTITION BY coalesce(html, ''))
            THEN min(page_id) OVER (PARTITION BY coalesce(html, '')) END AS refers_to
FROM pages""",
)
def op4_warc(spark, sf_dir):
    read = warc.round_trip(spark, table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return read.where("kind = 'record'").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query(
    "op5_preference",
    """
WITH turns AS (
  SELECT conv_id AS conv, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS LAST, coalesce(role, ''), coalesce(text, '')) - 1 AS pos,
         coalesce(role, '') AS role, coalesce(text, '') AS text
  FROM conversations WHERE conv_id IS NOT NULL),
lasts AS (SELECT conv, max(pos) AS last FROM turns GROUP BY conv),
rejects AS (
  SELECT conv, pos, role, text FROM turns JOIN lasts USING (conv) WHERE pos < last
  UNION ALL
  SELECT mine.conv, mine.last, t.role, t.text
  FROM turns t JOIN lasts l ON l.conv = t.conv AND t.pos = l.last
  JOIN lasts mine ON mine.conv = CASE WHEN (t.conv % 2 + 2) % 2 = 0 THEN t.conv + 1 ELSE t.conv - 1 END),
prefixes AS (
  SELECT conv, coalesce(min(CASE WHEN c.text IS NULL OR r.text IS NULL OR c.role <> r.role OR c.text <> r.text THEN pos END), max(pos) + 1) AS n
  FROM turns c FULL JOIN rejects r USING (conv, pos) GROUP BY conv),
sides AS (
  SELECT conv, pos, role, text, 'c' AS side FROM turns UNION ALL SELECT conv, pos, role, text, 'r' FROM rejects),
pieces AS (
  SELECT conv, n, pos, role, CASE WHEN pos < n THEN 'p' ELSE side END AS part,
         '<|start|>' || role || chr(10) || text || '<|end|>' || chr(10) AS piece, length(text) AS len
  FROM sides JOIN prefixes USING (conv) WHERE side = 'c' OR pos >= n),
spans AS (
  SELECT *, sum(length(piece)) OVER (PARTITION BY conv, part ORDER BY pos ROWS UNBOUNDED PRECEDING) - len - 8 AS begins FROM pieces),
parts AS (
  SELECT conv, n, part, string_agg(piece, '' ORDER BY pos) AS whole,
         string_agg(begins || '-' || (begins + len + 7), ',' ORDER BY pos) FILTER (WHERE role = 'assistant') AS mask
  FROM spans GROUP BY conv, n, part)
SELECT conv AS pair, CAST(any_value(n) AS INTEGER) AS prefix_turns,
       md5(coalesce(max(whole) FILTER (WHERE part = 'p'), '')) AS prompt_md5,
       md5(coalesce(max(whole) FILTER (WHERE part = 'c'), '')) AS chosen_md5,
       md5(coalesce(max(whole) FILTER (WHERE part = 'r'), '')) AS rejected_md5,
       coalesce(max(mask) FILTER (WHERE part = 'c'), '') AS chosen_spans,
       coalesce(max(mask) FILTER (WHERE part = 'r'), '') AS rejected_spans
FROM parts GROUP BY conv""",
)
def op5_preference(spark, sf_dir):
    turns = stored(preference.turns_of(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")), "turns")
    pairs = preference.preference_pairs(turns, preference.swapped_endings(turns))
    spans = lambda c: F.concat_ws(",", F.transform(c, lambda s: F.concat_ws("-", s["start"], s["end"])))
    return pairs.select(
        "pair", "prefix_turns", F.md5("prompt").alias("prompt_md5"), F.md5("chosen").alias("chosen_md5"), F.md5("rejected").alias("rejected_md5"),
        spans("chosen_mask").alias("chosen_spans"), spans("rejected_mask").alias("rejected_spans"),
    )


def _ranks_sql(name: str, src: str, dst: str, seed: str, rounds: int = url_filter.ROUNDS) -> str:
    """One CTE per round of the walk."""
    damping = url_filter.DAMPING
    steps = [f"""
{name}_share AS (SELECT {src} AS src, {dst} AS dst, weight / sum(weight) OVER (PARTITION BY {src}) AS share FROM edges),
{name}_seed AS (SELECT host, {seed} / sum({seed}) OVER () AS seed FROM seeds WHERE {seed} > 0),
{name}0 AS (SELECT host, seed AS rank FROM {name}_seed)"""]
    for i in range(rounds):
        steps.append(f"""
{name}_moved{i + 1} AS (SELECT dst AS host, sum(rank * share * {damping}::DOUBLE) AS part FROM {name}_share JOIN {name}{i} ON src = host GROUP BY dst),
{name}{i + 1} AS (SELECT host, sum(part) AS rank FROM (
  SELECT host, part FROM {name}_moved{i + 1}
  UNION ALL SELECT host, seed * (1 - (SELECT coalesce(sum(part), 0) FROM {name}_moved{i + 1})) FROM {name}_seed) GROUP BY host)""")
    return ",".join(steps)


@query(
    "op2_url_filter",
    r"""
WITH parts AS (
  SELECT page_id, html,
         coalesce(translate(regexp_extract(url, '^(?s:.*?)://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(url, '^(?s:.*?)://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
rules(rule_host, prefix, rule_verdict) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
fitted AS (
  SELECT page_id, rule_host || prefix AS rule, rule_verdict FROM parts JOIN rules
    ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, prefix)
  QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY length(rule_host || prefix) DESC) = 1),
ruled AS (SELECT parts.*, rule, rule_verdict FROM parts LEFT JOIN fitted USING (page_id)),
seeds AS (
  SELECT host, count(*) FILTER (WHERE rule_verdict = 'allow') AS allow, count(*) FILTER (WHERE rule_verdict = 'block') AS block
  FROM ruled WHERE rule IS NOT NULL AND host <> '' GROUP BY host),
found AS (
  SELECT host AS src, unnest(regexp_extract_all(html, '(?i)(?:href|src)\s*=\s*["'']?\s*((?:https?:)?//[^"''\s>]+)', 1)) AS link FROM parts),
targets AS (
  SELECT src, translate(regexp_extract(link, '//([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS dst FROM found),
hosts AS (SELECT DISTINCT host FROM parts),
known AS (
  SELECT host AS src, regexp_extract(host, '^[^.]+\.([^.]+\..+)$', 1) AS dst FROM hosts WHERE regexp_matches(host, '^[^.]+\.([^.]+\..+)$')),
edges AS (
  SELECT src, dst, count(*) AS weight FROM (
    SELECT src, dst FROM targets WHERE src <> '' AND dst <> '' AND src <> dst
    UNION ALL SELECT src, dst FROM known UNION ALL SELECT dst, src FROM known) GROUP BY src, dst),"""
    + _ranks_sql("trust", "src", "dst", "allow")
    + ","
    + _ranks_sql("distrust", "dst", "src", "block")
    + f"""
SELECT page_id, ruled.host, path, rule,
       coalesce(rule_verdict, CASE WHEN round(coalesce(d.rank, 0) - coalesce(t.rank, 0), 9) > 0 THEN 'block' ELSE 'allow' END) AS verdict,
       round(coalesce(t.rank, 0), 6) AS trust, round(coalesce(d.rank, 0), 6) AS distrust
FROM ruled LEFT JOIN trust{url_filter.ROUNDS} t ON t.host = ruled.host LEFT JOIN distrust{url_filter.ROUNDS} d ON d.host = ruled.host""",
)
def op2_url_filter(spark, sf_dir):
    found = url_filter.judged(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return found.select("row.page_id", "host", "path", "rule", "verdict", F.round("trust", 6).alias("trust"), F.round("distrust", 6).alias("distrust"))


@query("op1_ann")
def op1_ann(spark, sf_dir):
    return ann.nearest_neighbours(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), "id % 50 = 0")


@query("op6_language_mixture")
def op6_language_mixture(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = language_mixture.learn(docs.where(~language_mixture.held_out()).select("text", "lang"))
    rows = docs.select("doc_id", language_mixture.held_out().alias("held_out"), "text")
    return language_mixture.identify(rows, model).select("doc_id", "held_out", "lang_pred", "score", "languages")


@query("op8_toxicity")
def op8_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    net = toxicity.learned(docs.where(~toxicity.held_out()), table(spark, sf_dir, "labels").where(~toxicity.held_out()))
    rows = docs.select("doc_id", toxicity.held_out().alias("held_out"), "text")
    return toxicity.scored(rows, net).select("doc_id", "held_out", "score", "predicted")


@query(
    "op13_jaccard_join",
    """
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\\x20\\x09-\\x0D]+') AS w
  FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 3
      THEN list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' '))
      WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s
  FROM words),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
shared AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common
  FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (
  SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
  WHERE 100 * common >= 90 * (x.n + y.n - common)),
reach(doc_id, other) AS (
  SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, l.b FROM reach r JOIN links l ON l.a = r.other)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, m.component_id
FROM documents d LEFT JOIN sizes USING (doc_id)
JOIN (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id) m ON m.doc_id = d.doc_id""",
)
def op13_jaccard_join(spark, sf_dir):
    found = jaccard_join.components(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_shingles", "component_id")


@query("op12_whitening")
def op12_whitening(spark, sf_dir):
    rows = whitening.whitened(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    parts = F.posexplode(F.arrays_zip("whitened", "explained"))
    return rows.select("vec_id", "n", "deviation", "identity_error", parts).select(
        "vec_id", (F.col("pos") + 1).alias("component"), "n", "deviation", "col.whitened", "col.explained", "identity_error"
    )


def _edits_sql() -> str:
    """Cheapest edits from the last row to the first: per state {c: cost, a: edits, r: turns}."""
    after = repair.NEXT
    option = lambda cost, edit, to, turn: f"{{'c': {cost} + {to}.c, 'a': '{edit}' || {to}.a, 'r': {f'[{turn}] || ' if turn else ''}{to}.r}}"
    taken = []
    for s in range(4):
        kept = " ".join(f"WHEN NOT gone AND initial = '{i}' THEN {option('late', 'K', f'f{to[s]}', quoted)}" for i, to in repair.KEPT.items() if to[s] is not None for quoted in ["role || ':' || text"])
        role = repair.ROLE[after[s]]
        moved = f"CASE WHEN NOT gone THEN {option('2 + late', 'R', f'f{after[s]}', repr(role + ':') + ' || text')} END"
        taken.append(f"list_min([{option('3', 'D', f'f{s}', '')}, CASE {kept} END, {moved}]) AS g{s}")
    best = []
    for s in range(4):
        one, two = after[s], after[after[s]]
        turn = lambda t: repr(repair.ROLE[t] + ":")
        best.append(f"list_min([g{s}, {option('2', 'I', f'g{one}', turn(one))}, {option('4', 'II', f'g{two}', turn(one) + ', ' + turn(two))}]) AS f{s}")
    none = "[]::VARCHAR[]"
    ends = [f"{{'c': 0, 'a': '', 'r': {none}}}", "{'c': 4, 'a': 'II', 'r': ['user:', 'assistant:']}", "{'c': 2, 'a': 'I', 'r': ['assistant:']}", f"{{'c': 0, 'a': '', 'r': {none}}}"]
    return f"""
edits AS (
  SELECT conv, count(*) AS pos, {", ".join(f"{e} AS f{s}" for s, e in enumerate(ends))} FROM judged GROUP BY conv
  UNION ALL
  SELECT conv, pos, {", ".join(best)} FROM (
    SELECT j.conv, j.pos, {", ".join(taken)}
    FROM edits e JOIN judged j ON j.conv IS NOT DISTINCT FROM e.conv AND j.pos = e.pos - 1))"""


@query(
    "op11_conversation_repair",
    r"""
WITH RECURSIVE crc(t) AS (
  SELECT list(c ORDER BY i) FROM (
    SELECT i, list_reduce([i] || range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) AS r(i))),
fated AS (
  SELECT conv_id AS conv, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         xor(list_reduce([4294967295::BIGINT] || list_transform(str_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''), lambda x: ord(x)::BIGINT),
             lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 20 AS fate
  FROM conversations, crc),
damaged AS (
  SELECT conv, turn, CASE WHEN fate = 4 THEN 'user' ELSE role END AS role,
         CASE fate WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
         unnest(CASE WHEN fate = 3 THEN [0, 1] ELSE [0] END) AS again
  FROM fated WHERE fate <> 0),
numbered AS (
  SELECT conv, turn, role, text, substr(role, 1, 1) AS initial, row_number() OVER (PARTITION BY conv ORDER BY turn NULLS FIRST, role, text) - 1 AS pos FROM damaged),
flagged AS (
  SELECT *, regexp_full_match(text, '[\x20\x09-\x0D]*') AS is_blank, row_number() OVER (PARTITION BY conv, role, text ORDER BY pos) > 1 AS is_again,
         NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') AS is_cut, lag(initial) OVER (PARTITION BY conv ORDER BY pos) || initial AS pair
  FROM numbered),
judged AS (
  SELECT conv, pos, turn, role, text, initial, pair, is_blank OR is_again AS gone, is_blank, NOT is_blank AND is_again AS is_again,
         NOT is_blank AND NOT is_again AND is_cut AS is_cut, CASE WHEN NOT is_blank AND NOT is_again AND is_cut THEN 1 ELSE 0 END AS late
  FROM flagged),"""
    + _edits_sql()
    + """,
counted AS (
  SELECT conv, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE is_blank) AS blank,
         count(*) FILTER (WHERE is_again) AS duplicate, count(*) FILTER (WHERE is_cut) AS truncated,
         count(*) FILTER (WHERE pair IS NOT NULL AND pair NOT IN ('su', 'ua', 'au')) AS illegal
  FROM judged GROUP BY conv)
SELECT o.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
       coalesce(illegal, 0)::BIGINT AS illegal, coalesce(f0.c, 0)::BIGINT AS cost, coalesce(f0.a, '') AS audit, sha256(coalesce(array_to_string(f0.r, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o
LEFT JOIN counted c ON c.conv IS NOT DISTINCT FROM o.conv_id
LEFT JOIN edits e ON e.conv IS NOT DISTINCT FROM o.conv_id AND e.pos = 0""",
)
def op11_conversation_repair(spark, sf_dir):
    return repair.repair_of_damaged(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"))
