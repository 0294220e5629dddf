"""The registered queries of the operators for training text, and SQL where it can say the same."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from throughline.llm import bpe, caps, chat, decontaminate, hmm, langid, lines, pieces, repair, runindex, simhash, toxicity, turntrie
from throughline.llm.frames import held_out, read

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.tiktoken")
PIECE_BPE = public_tokenizers.path("piece_bpe_32k.model")


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole document encoded to ids and decoded again."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    coded = bpe.encode(docs, BYTE_BPE, public_tokenizers.PATTERN, keep=["doc_id"])
    return bpe.decode(coded, BYTE_BPE).select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the lines that are like an earlier one."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return lines.dedup(docs).select(
        "doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("kept", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The expected severity of every document, learnt from the labelled ones."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(toxicity.severity_grades(docs, read(spark, sf_dir, "labels")))
    return toxicity.predict(docs, model).select(
        "doc_id", "severity", "p_toxic", "grade", (F.col("p_toxic") >= 0.5).alias("toxic"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every pair of a document and a benchmark item that it holds."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.find_leaks(docs, read(spark, sf_dir, "benchmark")).select("doc_id", F.explode("leaks").alias("leak"))
    return found.select("doc_id", "leak.item_id", "leak.score", "leak.question", "leak.answer")


def op4_hmm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hidden Markov model's log10 probability of every document beside the unigram base."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return hmm.score(docs, train=~held_out(F.col("doc_id"), 7, 2))


#: A conversation whose texts hold the format's own control strings.
CONFLICT = [(-7, 0, "user", "\\### Assistant: </turn> ok"), (-7, 1, "assistant", "\\### Assistant: </turn> ok")]


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation formatted, and what its format says when it is read back."""
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    rows = rows.unionByName(spark.createDataFrame(CONFLICT, "conv_id long, turn long, role string, text string"))
    return chat.digests(chat.format_turns(rows))


OP7_SQL = r"""
with turns as (
    select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
    union all select -7, 0, 'user', '\### Assistant: </turn> ok'
    union all select -7, 1, 'assistant', '\### Assistant: </turn> ok'
), sized as (
    select *, case when role in ('system', 'user', 'assistant', 'tool') then length(role)
                   else 5 + length(replace(replace(replace(role, '%', '%25'), ':', '%3A'), chr(10), '%0A')) end as label,
        length(regexp_replace(regexp_replace(text,
            '(\\*)(### (?:System|User|Assistant|Tool|Role [^:\n]*): |</turn>)', '\1\1\\\2', 'g'), '(\\+)\z', '\1\1')) as body
    from turns
)
select conv_id, count(*)::bigint as n_turns,
    sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn)) as turns_sha256,
    sum(case when role = 'assistant' then length(text) else 0 end)::bigint as loss_chars,
    sha256(coalesce(string_agg(text, '' order by turn) filter (role = 'assistant'), '')) as loss_sha256,
    sum(4 + label + 2 + body + 8)::bigint as formatted_chars
from sized group by conv_id
"""


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's fingerprint and the least document within reach of links of two bits."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return simhash.groups(docs, words=3, radius=2).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op8_embedding_caps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector's number of neighbours at cosine 0.9 or more, and its component."""
    return caps.near_duplicates(read(spark, sf_dir, "embeddings"), threshold=0.9)


OP8_SQL = """
with recursive v as (
    select vec_id, list_transform(embedding, lambda x: x::double) as e from embeddings
    where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
      and len(list_filter(embedding, lambda x: x != 0)) > 0
), links as (
    select a.vec_id as u, b.vec_id as v from v a join v b on a.vec_id != b.vec_id and list_cosine_similarity(a.e, b.e) >= 0.9
), reach as (
    select vec_id as u, vec_id as c from embeddings union select l.v, r.c from reach r join links l on l.u = r.u
), counted as (select u, count(*) as n from links group by u)
select r.u as vec_id, coalesce(any_value(n), 0)::bigint as n_links, min(c) as component_id, min(c) = r.u as kept
from reach r left join counted k on k.u = r.u group by r.u
"""


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The predicted language of every document; learnt outside of the held-out quarter."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    out = held_out(F.col("doc_id"), 4, 2)
    return langid.identify(docs, ~out).select("doc_id", out.alias("held_out"), "lang_pred", "score")


def op10_run_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the bytes that lie in a 400-byte string which also starts elsewhere."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return runindex.remove(docs, length=400).select(
        "doc_id", "n_bytes", (F.col("n_bytes") - F.length("kept")).cast("long").alias("n_removed"),
        (F.size("removed") / 2).cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


#: crc32 of the ASCII text `key`, bit by bit.
CRC32 = """xor(list_reduce(list_prepend(4294967295::ubigint, list_transform(string_split(key, ''), lambda ch: ascii(ch)::ubigint)),
    lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)::ubigint[]),
        lambda x, k: case when x & 1 = 1 then xor(x >> 1, 3988292384::ubigint) else x >> 1 end)), 4294967295::ubigint)"""


def op11_structure_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every damaged conversation's faults, its cheapest repair, and a digest of the repaired turns."""
    return repair.report(repair.repair(repair.damage(read(spark, sf_dir, "conversations"))))


OP11_SQL = f"""
with recursive keyed as (
    select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text,
        coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ') as key from conversations
), harmed as (
    select *, {CRC32} % 20 as harm from keyed
), damaged as (
    select conv_id, turn, case when harm = 4 then 'user' else role end as role,
        case when harm = 1 then '' when harm = 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text,
        unnest(case when harm = 3 then [1, 2] else [1] end) as copy
    from harmed where harm != 0
), placed as (
    select *, row_number() over w as pos, row_number() over (partition by conv_id, role, text order by turn nulls first, copy) > 1 as again,
        regexp_extract(text, '([^\\x20\\x09-\\x0D])[\\x20\\x09-\\x0D]*\\z', 1) as shown, left(role, 1) as first,
        lead(left(role, 1)) over w as following, lead(1) over w as more
    from damaged window w as (partition by conv_id order by turn nulls first, role, text, copy)
), faults as (
    select *, case when shown = '' then 'blank' when again then 'duplicate' when shown not in ('.', '!', '?') then 'truncated' end as fault from placed
), counted as (
    select conv_id, count(*) as n, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps,
        count(*) filter (fault = 'blank') as blank, count(*) filter (fault = 'duplicate') as duplicate,
        count(*) filter (fault = 'truncated') as truncated,
        count(*) filter (more = 1 and first || following not in ('su', 'ua', 'au')) as illegal
    from faults group by conv_id
), moves as (
    select conv_id, pos, first, coalesce(fault in ('blank', 'duplicate'), false) as must, case when fault = 'truncated' then 1 else 0 end as late from faults
), ahead as (
    select conv_id, n + 1 as pos, 0::bigint as c0, '' as a0, 4::bigint as c1, 'II' as a1, 2::bigint as c2, 'I' as a2, 0::bigint as c3, '' as a3 from counted
    union all
    select conv_id, pos, f0.c, f0.a, f1.c, f1.a, f2.c, f2.a, f3.c, f3.a from (
        select *, list_min([g0, {{'c': 2 + f2.c, 'a': 'I' || f2.a}}]) as f0, list_min([g1, {{'c': 2 + f2.c, 'a': 'I' || f2.a}}]) as f1 from (
            select *, list_min([g2, {{'c': 2 + g3.c, 'a': 'I' || g3.a}}]) as f2, list_min([g3, {{'c': 2 + g2.c, 'a': 'I' || g2.a}}]) as f3 from (
                select m.conv_id, m.pos,
                    list_min([{{'c': 3 + c0, 'a': 'D' || a0}}, {{'c': case when must then 1e12::bigint else 2 + late + c2 end, 'a': 'R' || a2}},
                        {{'c': case when must then 1e12::bigint when first = 's' then late + c1 when first = 'u' then late + c2 else 1e12::bigint end,
                          'a': 'K' || case when first = 's' then a1 else a2 end}}]) as g0,
                    list_min([{{'c': 3 + c1, 'a': 'D' || a1}}, {{'c': case when must then 1e12::bigint else 2 + late + c2 end, 'a': 'R' || a2}},
                        {{'c': case when must or first != 'u' then 1e12::bigint else late + c2 end, 'a': 'K' || a2}}]) as g1,
                    list_min([{{'c': 3 + c2, 'a': 'D' || a2}}, {{'c': case when must then 1e12::bigint else 2 + late + c3 end, 'a': 'R' || a3}},
                        {{'c': case when must or first != 'a' then 1e12::bigint else late + c3 end, 'a': 'K' || a3}}]) as g2,
                    list_min([{{'c': 3 + c3, 'a': 'D' || a3}}, {{'c': case when must then 1e12::bigint else 2 + late + c2 end, 'a': 'R' || a2}},
                        {{'c': case when must or first != 'u' then 1e12::bigint else late + c2 end, 'a': 'K' || a2}}]) as g3
                from ahead h join moves m on m.conv_id is not distinct from h.conv_id and m.pos = h.pos - 1)))
), best as (
    select conv_id, c0 as cost, a0 as audit from ahead where pos = 1
), letters as (
    select conv_id, audit, unnest(range(1, length(audit) + 1)) as i from best
), edits as (
    select conv_id, substr(audit, i, 1) as edit, length(replace(substr(audit, 1, i), 'I', '')) as pos,
        length(replace(substr(audit, 1, i), 'D', '')) as place from letters
), kept as (
    select e.conv_id, e.edit, e.place, f.role, f.text, f.first from edits e
    left join faults f on f.conv_id is not distinct from e.conv_id and f.pos = e.pos and e.edit != 'I' where e.edit != 'D'
), led as (
    select *, max(case when place = 1 and edit = 'K' and first = 's' then 1 else 0 end) over (partition by conv_id) as led from kept
), repaired as (
    select conv_id, sha256(string_agg(case when edit = 'K' then role when (place - led) % 2 = 1 then 'user' else 'assistant' end
        || ':' || case when edit = 'I' then '' else text end, chr(10) order by place)) as repaired_sha256 from led group by conv_id
)
select k.conv_id, coalesce(c.gaps, 0)::bigint as gaps, coalesce(c.blank, 0)::bigint as blank, coalesce(c.duplicate, 0)::bigint as duplicate,
    coalesce(c.truncated, 0)::bigint as truncated, coalesce(c.illegal, 0)::bigint as illegal, coalesce(b.cost, 0)::bigint as cost,
    coalesce(b.audit, '') as audit, coalesce(r.repaired_sha256, sha256('')) as repaired_sha256
from (select distinct conv_id from conversations) k left join counted c on c.conv_id is not distinct from k.conv_id
left join best b on b.conv_id is not distinct from k.conv_id left join repaired r on r.conv_id is not distinct from k.conv_id
"""


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node of the trie of all rebuilt conversations."""
    return turntrie.trie(turntrie.rebuilt(read(spark, sf_dir, "conversations")))


OP12_SQL = f"""
with turns as (
    select conv_id, coalesce(role, '') as role, coalesce(text, '') as text,
        row_number() over (partition by conv_id order by turn nulls first, role, text) as pos from conversations where conv_id is not null
), convs as (
    select conv_id, {CRC32} % 9 as h from (select distinct conv_id, conv_id::varchar as key from turns)
), built as (
    select c.conv_id, t.pos, t.role, t.text from convs c join turns t on t.conv_id = c.conv_id - c.conv_id % 5 and t.pos <= c.h
    union all
    select c.conv_id, t.pos + 1000000000, t.role, t.text from convs c join turns t on t.conv_id = c.conv_id and t.pos > c.h
), ordered as (
    select conv_id, row_number() over (partition by conv_id order by pos) as depth, strlen(text) as bytes,
        sha256(length(role) || ':' || role || text) as id from built
), paths as (
    select conv_id, depth, bytes, string_agg(id, '') over (partition by conv_id order by depth) as path from ordered
    union all select conv_id, 0, 0, '' from convs
), sized as (
    select *, max(depth) over (partition by conv_id) as size from paths
), nodes as (
    select path, min(depth) as depth, min(bytes) as bytes, min(conv_id) as conv_id, count(*) as n_convs,
        sha256(coalesce(string_agg(conv_id::varchar, ',' order by conv_id) filter (depth = size), '')) as ends_sha256 from sized group by path
), linked as (
    select n.*, p.conv_id as parent_conv_id, case when n.depth > 0 then substr(n.path, 1, length(n.path) - 64) end as above
    from nodes n left join nodes p on n.depth > 0 and p.path = substr(n.path, 1, length(n.path) - 64)
), children as (
    select above as path, count(*) as n_children from linked where above is not null group by above
), counted as (
    select l.*, coalesce(c.n_children, 0) as n_children from linked l left join children c on c.path = l.path
), sums as (
    select a.path, count(*) filter (b.n_children = 0) as n_leaves, sum((b.n_convs - 1) * b.bytes) as saved_tokens
    from counted b join sized a on a.conv_id = b.conv_id and a.depth <= b.depth group by a.path
)
select conv_id, depth::bigint as depth, parent_conv_id, n_convs::bigint as n_convs, n_children::bigint as n_children,
    n_leaves::bigint as n_leaves, saved_tokens::bigint as saved_tokens, ends_sha256 from counted join sums using (path)
"""


def op13_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole document encoded to ids with begin and end, and decoded again."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    coded = pieces.encode(docs, PIECE_BPE, packed=True, keep=["doc_id"])
    return pieces.decode(coded, PIECE_BPE).select(
        "doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


QUERIES = {
    "op1_byte_bpe": op1_byte_bpe,
    "op2_line_dedup": op2_line_dedup,
    "op3_toxicity": op3_toxicity,
    "op4_hmm_scores": op4_hmm_scores,
    "op5_decontamination": op5_decontamination,
    "op6_simhash": op6_simhash,
    "op7_chat_format": op7_chat_format,
    "op8_embedding_caps": op8_embedding_caps,
    "op9_language_id": op9_language_id,
    "op10_run_index": op10_run_index,
    "op11_structure_repair": op11_structure_repair,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_sentencepiece": op13_sentencepiece,
}
SQL = {"op7_chat_format": OP7_SQL, "op8_embedding_caps": OP8_SQL, "op11_structure_repair": OP11_SQL, "op12_prefix_trie": OP12_SQL}
