"""The queries of this subpackage: each applies an operator to its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trellis.llm import bpe, chats, codes, html, lines, lm, packing, passages, pii, quality, simhash, spelling, vectors
from trellis.llm.common import Scratch, load


def tokenizer_path(name: str) -> str:
    """Where the public vocabulary files are installed; operators take the path as a parameter."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_pii_skip_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    found = pii.detect(docs, pii.fit(docs))
    spans = F.split("base", ",")
    counts = [_count_kind(spans, kind) for kind in pii.KINDS]
    return found.select("doc_id", *counts, F.sha2("base", 256).alias("base_sha256"), "spans", "n_added")


def _count_kind(spans, kind: str):
    return F.size(F.filter(spans, lambda x: x.startswith(f"{kind}:"))).cast("long").alias(f"n_{kind}")


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    removed = lines.near_duplicate_lines(load(spark, sf_dir, "documents"), Scratch(spark, "op2"))
    return removed.withColumnsRenamed({"doc": "doc_id", "kept_doc": "kept_doc_id", "pos": "line_no", "kept_pos": "kept_line_no"})


def op3_lattice_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 7 == 2, F.lit(False))
    return lm.score(load(spark, sf_dir, "documents"), Scratch(spark, "op3"), tokenizer_path("piece_bpe_32k.model"), held_out, rounds=2)


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.assess(load(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op5_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.main_text(load(spark, sf_dir, "pages"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.near_duplicates(load(spark, sf_dir, "documents"), Scratch(spark, "op6"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op7_vector_passes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_duplicates(load(spark, sf_dir, "embeddings"), Scratch(spark, "op7"))


def op8_bpe_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(load(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def op9_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.repeated_passages(load(spark, sf_dir, "documents"), Scratch(spark, "op9"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(load(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def op11_chat_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    planted = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text"))
    rows = load(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").union(planted)
    path = tokenizer_path("byte_bpe_50k.json")
    return chats.read_back(Scratch(spark, "op11").table(chats.format_chats(rows, path), "chats"), path)


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(load(spark, sf_dir, "documents"), Scratch(spark, "op12"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codes.compressed(load(spark, sf_dir, "embeddings"), Scratch(spark, "op13"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [op1_pii_skip_chain, op2_line_dedup, op3_lattice_lm, op4_quality_rules, op5_main_text, op6_simhash, op7_vector_passes, op8_bpe_chunks, op9_passages, op10_packing, op11_chat_masks, op12_spelling_variants, op13_vector_codes]
    return {f.__name__: f for f in found}


def _quality_sql() -> str:
    space = r"[\x20\x09-\x0D]"
    word = r"[^\x20\x09-\x0D]"
    bare = f"regexp_replace(l, '{space}+', '', 'g')"
    boiler = " or ".join(f"(length(l) <= {quality.PHRASE_SHARE * len(p)} and contains(lower(l), '{p}'))" for p in quality.BOILERPLATE)
    at_least = lambda n: f"len(regexp_extract_all(l, '{word}+')) >= {n}"
    fails = f"""(regexp_matches(l, '[#*$%&|<>»›·•]') and (
            (length({bare}) - length(regexp_replace({bare}, '[#*$%&|<>]', '', 'g'))) * 10 > length({bare})
            or (length({bare}) - length(regexp_replace({bare}, '[|»›·•]', '', 'g'))) * 4 > len(regexp_extract_all(l, '{word}+'))))
        or {boiler}
        or (upper(l) = l and {at_least(5)} and regexp_matches(l, '\\p{{Lu}}'))
        or (not regexp_matches(l, '[.!?…。！？]') and {at_least(12)})"""
    return f"""
with d as (select doc_id, coalesce(text, '') t from documents),
w as (select doc_id, t, regexp_extract_all(t, '{word}+') w from d),
g as (select doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] g from (select doc_id, w, unnest(range(1, len(w) - 1)) i from w)),
r as (select doc_id, i from (select doc_id, i, count(*) over (partition by doc_id, g) n from g) where n > 1),
rep as (select doc_id, count(distinct i + k) n from r, (values (0), (1), (2)) v(k) group by 1),
ln as (select doc_id, unnest(string_split(t, chr(10))) l, generate_subscripts(string_split(t, chr(10)), 1) i from d),
cl as (select doc_id, count(*) filter (regexp_matches(l, '{word}')) - count(distinct l) filter (regexp_matches(l, '{word}')) dup,
        coalesce(sum(length(l)) filter (not ({fails})), 0) + greatest(count(*) filter (not ({fails})) - 1, 0) clean from ln group by 1),
c as (select w.doc_id, len(w) n_words, length(list_aggregate(w, 'string_agg', '')) word_chars,
        length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) n_symbols, dup, coalesce(rep.n, 0) n_rep, clean, length(t) all_chars
      from w left join rep using (doc_id) join cl using (doc_id))
select doc_id, n_words::bigint n_words, coalesce(word_chars, 0)::bigint word_chars, n_symbols::bigint n_symbols, dup::bigint n_dup_lines, n_rep::bigint n_repeat_words,
    n_words < 50 or n_rep * 100 > n_words * 50 base_failed,
    not (n_words < 50 or n_rep * 100 > n_words * 50) and (all_chars = 0 or 1 - clean::double / all_chars <= 0.5) kept
from c"""


VECTOR_SQL = """
with recursive v as (select vec_id, embedding::double[] e from embeddings where embedding is not null),
n as (select vec_id, e, sqrt(list_dot_product(e, e)) s from v),
l as (select a.vec_id a, b.vec_id b from n a join n b on a.vec_id <> b.vec_id and a.s > 0 and b.s > 0 and list_dot_product(a.e, b.e) / (a.s * b.s) >= 0.9),
reach as (select vec_id, vec_id c from embeddings union select r.vec_id, l.b from reach r join l on r.c = l.a),
k as (select vec_id, min(c) component_id from reach group by 1)
select k.vec_id, (select count(*) from l where l.a = k.vec_id) n_links, component_id, k.vec_id = component_id kept from k"""


CHAT_SQL = r"""
with c as (select conv_id, turn, role, coalesce(text, '') t from conversations union all values (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')),
e as (select *, length(regexp_replace(t, '([\[<])(\\*)(/?INST\]|/?SYS\]|ROLE\]|/?TEXT\]|/s>)', '\1\\\2\3', 'g')) n from c)
select conv_id, count(*) n_turns, sha256(string_agg(role || chr(10) || t || chr(10), '' order by turn)) turns_sha256,
    coalesce(sum(length(t)) filter (role = 'assistant'), 0)::bigint loss_chars, sha256(coalesce(string_agg(t, '' order by turn) filter (role = 'assistant'), '')) loss_sha256,
    sum(n + case role when 'user' then 13 when 'system' then 11 when 'assistant' then 4 else 19 + length(role) end)::bigint formatted_chars
from e group by conv_id""".replace("\\", "\\")


SPELLING_SQL = r"""
with recursive t as (select list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end)) crc),
runs as (select doc_id, unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\x{C0}-\x{FF}]+')) w from documents),
low as (select doc_id, translate(w, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') w, count(*) n from runs group by all),
bytes as (select w, n, hex(encode(doc_id::varchar || ':' || w)) b from low),
hashed as (select w, n, xor(list_reduce(list_prepend(4294967295, list_transform(range(1, length(b), 2), lambda i: ('0x' || substr(b, i, 2))::bigint)), lambda a, x: xor(a >> 8, crc[xor(a & 255, x) + 1])), 4294967295) h from bytes, t),
cut as (select case when h % 97 = 0 then substr(w, 1, (h % length(w))::int) || substr(w, (h % length(w))::int + 2) else w end word, n from hashed),
words as materialized (select word, sum(n)::bigint n from cut where length(word) >= 5 group by 1 having sum(n) >= 3),
gone as materialized (select word, i, substr(word, 1, i::int - 1) || substr(word, i::int + 1) d from words, lateral (select unnest(range(1, length(word) + 1)) i)),
near as materialized (select a.word a, b.word b from gone a join gone b on a.d = b.d and a.i = b.i and a.word <> b.word
    union select w.word, g.word from words w join gone g on g.d = w.word union select g.word, w.word from words w join gone g on g.d = w.word),
best as (select a word, count(*) n_near, max({'n': n, 'neg': -r}) m from near join (select word, n, row_number() over (order by word) r from words) x on x.word = b group by 1),
form as materialized (select words.word, words.n, coalesce(n_near, 0) n_near, case when m.n >= 2 * words.n then m.n end form_n, case when m.n >= 2 * words.n then o.word end form
    from words left join best using (word) left join (select word, row_number() over (order by word) r from words) o on o.r = -m.neg),
up as (select word, word spot from form union all select up.word, form.form from up join form on form.word = up.spot where form.form is not null),
root as (select up.word, spot root from up join form on form.word = up.spot where form.form is null)
select word, form, root, n, n_near, form_n from form join root using (word)""".replace("\\", "\\")


def _codes_sql(parts: int = 8, entries: int = 16, rounds: int = 6) -> str:
    """Lloyd's rounds, one after another, in long form."""
    steps = []
    for k in range(rounds + 1):
        steps.append(f"""a{k} as materialized (select row, pos, min({{'d': d, 'entry': entry}}) m from (select row, x.pos, entry, sum((x.x - c.x) * (x.x - c.x)) d from x join c{k} c on c.pos = x.pos and c.i = x.i group by all) group by all)""")
        if k < rounds:
            steps.append(f"""c{k + 1} as materialized (select c.pos, c.entry, c.i, coalesce(s.x, c.x) x from c{k} c left join (select x.pos, m.entry entry, i, floor(sum(x)::double / count(*))::bigint x from x join a{k} using (row, pos) group by 1, 2, 3) s on s.pos = c.pos and s.entry = c.entry and s.i = c.i)""")
    return f"""
with v as materialized (select row_number() over (order by vec_id) row, vec_id, label, list_transform(embedding, lambda x: floor(x::double * 4096)::bigint) q from embeddings where embedding is not null and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0),
x as materialized (select row, j // (len(q) // {parts}) pos, j % (len(q) // {parts}) i, q[j + 1] x from (select row, q, unnest(range(len(q))) j from v)),
c0 as materialized (select pos, row - 1 entry, i, x from x where row <= {entries}),
{", ".join(steps)},
e as (select row, sum(m.d)::bigint error, string_agg(printf('%02x', m.entry), '' order by pos) code from a{rounds} group by 1),
k as (select sha256(string_agg(x::varchar, ',' order by pos, entry, i)) codebooks_sha256 from c{rounds})
select vec_id, code, error, (sum(error) over (partition by label))::bigint label_error, codebooks_sha256 from v join e using (row), k"""


def oracle_sql() -> dict[str, str]:
    """Only what SQL can express over whole tables; the others have brute-force tests."""
    return {"op4_quality_rules": _quality_sql(), "op7_vector_passes": VECTOR_SQL, "op11_chat_masks": CHAT_SQL, "op12_spelling_variants": SPELLING_SQL, "op13_vector_codes": _codes_sql()}
