"""The queries of this package, by name, and the SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quire.llm.common import table
from quire.llm.conversations import structure
from quire.llm.decontam import contaminated
from quire.llm.fingerprint import fingerprints
from quire.llm.langid import languages
from quire.llm.licences import licences
from quire.llm.merkle import manifest
from quire.llm.minhash import near_duplicates
from quire.llm.pieces import round_trip
from quire.llm.pii import find_private
from quire.llm.quality import classify
from quire.llm.rangecoder import token_round_trip
from quire.llm.suffixdedup import remove_repeats
from quire.llm.warc import archive_round_trip


def op6_bottom_k_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents"))


def op7_circulant_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), size=3, percent=85)


def op1_warc_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive_round_trip(table(spark, sf_dir, "pages"))


def op2_simhash_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def tokenizer_path(name: str) -> str:
    """Where the box keeps the files of public tokenizers; operators take the path as a parameter."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op3_unigram_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op4_range_coded_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_round_trip(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), end=2)


def op5_attention_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_output_code_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return languages(table(spark, sf_dir, "documents"))


def op9_deep_shallow_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"), with_text=False)


def op10_weak_supervision_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_private(table(spark, sf_dir, "documents"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest(table(spark, sf_dir, "documents"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure(table(spark, sf_dir, "conversations"))


def op13_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences(table(spark, sf_dir, "documents")).drop("expressions")


# What SQL can say of operators whose other columns it cannot: the same operators, fewer columns.


def quality_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op5_attention_quality(spark, sf_dir).select("doc_id", "held_out")


def language_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op8_output_code_language(spark, sf_dir).select("doc_id", "held_out")


def edited_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op6_bottom_k_fingerprint(spark, sf_dir).select("doc_id", "n_chars", "edited_sha256")


def decoded_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op3_unigram_pieces(spark, sf_dir).select("doc_id", "n_bytes", "decoded_sha256")


def private_base_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op10_weak_supervision_pii(spark, sf_dir).drop("spans", "n_added")


def license_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op13_license_scan(spark, sf_dir).drop("labels", "score")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_warc_chunks": op1_warc_chunks,
    "op2_simhash_decontamination": op2_simhash_decontamination,
    "op3_unigram_pieces": op3_unigram_pieces,
    "op4_range_coded_tokens": op4_range_coded_tokens,
    "op5_attention_quality": op5_attention_quality,
    "op8_output_code_language": op8_output_code_language,
    "op6_bottom_k_fingerprint": op6_bottom_k_fingerprint,
    "op7_circulant_minhash": op7_circulant_minhash,
    "op9_deep_shallow_suffixes": op9_deep_shallow_suffixes,
    "op10_weak_supervision_pii": op10_weak_supervision_pii,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_conversation_repair": op12_conversation_repair,
    "op13_license_scan": op13_license_scan,
    "quality_folds": quality_folds,
    "language_folds": language_folds,
    "edited_texts": edited_texts,
    "decoded_pieces": decoded_pieces,
    "private_base_spans": private_base_spans,
    "license_base": license_base,
}



def _crc(text: str) -> str:
    """The crc32 of an ASCII text, bit by bit."""
    step = "lambda a, b: list_reduce(list_prepend(xor(a, b), range(8)), lambda x, k: xor(x >> 1, 3988292384 * (x & 1)))"
    return f"xor(list_reduce(list_prepend(4294967295::bigint, list_transform(string_split({text}, ''), lambda c: ascii(c)::bigint)), {step}), 4294967295)"


def _folds(parts: int, held: int) -> str:
    return f"select doc_id, case when doc_id is null then false else {_crc('doc_id::varchar')} % {parts} = {held} end as held_out from documents"


def _field(column: str) -> str:
    return f"coalesce(octet_length(encode({column}::varchar))::varchar || ':' || {column}::varchar, '-')"


_LEAF = " || ".join(map(_field, ("doc_id", "source", "lang", "n_chars")))
_LOW = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
#: The ways into each state by one insert, as (from, to).
_NEXT = {"e": "u", "s": "u", "u": "a", "a": "u"}


def _least(*ways: str) -> str:
    """The least of (cost, audit) structs; nulls are no ways."""
    return f"list_sort(list_filter([{', '.join(ways)}], lambda w: w is not null))[1]"


def _way(state: str, cost: str, edit: str, when: str = "true") -> str:
    return f"case when {state} is not null and {when} then {{'c': {state}.c + {cost}, 'a': {state}.a || '{edit}'}} end"


def _repair() -> tuple[str, str]:
    """SQL of the states after a turn, and of the states after at most one insert more."""
    more, free = "cut", "not goes"
    took = {
        "e": [_way("e", "3", "D")],
        "s": [_way("s", "3", "D"), _way("e", more, "K", f"{free} and i = 's'")],
        "u": [_way("u", "3", "D")] + [_way(x, f"2 + {more}", "R", free) for x in "esa"] + [_way(x, more, "K", f"{free} and i = 'u'") for x in "esa"],
        "a": [_way("a", "3", "D"), _way("u", f"2 + {more}", "R", free), _way("u", more, "K", f"{free} and i = 'a'")],
    }
    turn = ", ".join(f"{_least(*ways)} as {state}" for state, ways in took.items())
    insert = ", ".join(f"{_least(state, *[_way(x, '2', 'I') for x, to in _NEXT.items() if to == state])} as {state}" for state in "esua")
    return turn, insert


ORACLES: dict[str, str] = {
    "op1_warc_chunks": """
        with p as (select page_id, coalesce(html, '') as h from pages),
        k as (select page_id, h, strlen(h) as n, sha1(h) as x from p),
        g as (select x, n, max(page_id) as top from k where page_id is not null group by x, n),
        a as (select range as i, substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', range + 1, 1) as c from range(32)),
        d as (select x, string_agg(c, '' order by j) as digest
              from (select x, j, (('0x' || substr(x, 5 * (j // 4) + 1, 5))::bigint >> (15 - 5 * (j % 4))) & 31 as i
                    from (select distinct x from k), (select range as j from range(32))) join a using (i)
              group by x)
        select k.page_id, k.n::bigint as payload_bytes, d.digest as payload_digest,
               case when k.page_id < g.top then 'revisit' else 'response' end as record_type,
               case when k.page_id < g.top then g.top end as refers_to,
               greatest(1, case when k.page_id < g.top then 1 else ceil(k.n / 65536.0) end)::int as n_chunks
        from k join d using (x) left join g on g.x = k.x and g.n = k.n
    """,
    "op7_circulant_minhash": r"""
        with recursive w as (
          select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
        s as (
          select doc_id, list_distinct(case when len(w) = 0 then [] when len(w) < 3 then [array_to_string(w, ' ')]
                 else list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) end) as s from w),
        n as (select doc_id, len(s)::bigint as n from s),
        x as (select doc_id, unnest(s) as g from s),
        p as (select a.doc_id as a, b.doc_id as b, count(*) as both from x a join x b on a.g = b.g and a.doc_id < b.doc_id group by all),
        l as (select a, b from p join n na on na.doc_id = a join n nb on nb.doc_id = b where 100 * p.both >= 85 * (na.n + nb.n - p.both)),
        e as (select a, b from l union all select b, a from l),
        r(doc_id, c) as (select doc_id, doc_id from n union select e.b, r.c from r join e on e.a = r.doc_id),
        c as (select doc_id, min(c) as component_id from r group by doc_id)
        select n.doc_id, n.n as n_shingles, component_id, n.doc_id = component_id as kept from n join c using (doc_id)
    """,
    "op9_deep_shallow_suffixes": """
        with b as (select doc_id, encode(coalesce(text, '')) as b from documents),
        n as (select doc_id, b, octet_length(b) as n from b),
        w as (select doc_id, i, b[i + 1 : i + 50] as s from (select doc_id, b, unnest(range(n - 49)) as i from n where n >= 50)),
        g as (select s, min(doc_id) as least from w group by s),
        h as (select w.doc_id, w.i from w join g using (s) where w.doc_id > g.least),
        o as (select doc_id, i, case when i <= lag(i) over (partition by doc_id order by i) + 50 then 0 else 1 end as fresh from h),
        r as (select doc_id, i, sum(fresh) over (partition by doc_id order by i) as run from o),
        c as (select doc_id, run, min(i) as a, max(i) + 50 as z from r group by doc_id, run),
        k as (select doc_id, coalesce(lag(z) over (partition by doc_id order by a), 0) as lo, a as hi from c
              union all select doc_id, max(z), null from c group by doc_id),
        p as (select k.doc_id, string_agg(hex(b[lo + 1 : coalesce(hi, n)]), '' order by lo) as kept from k join n using (doc_id) where lo < coalesce(hi, n) group by k.doc_id),
        t as (select doc_id, sum(z - a)::bigint as removed, count(*) as spans from c group by doc_id)
        select n.doc_id, n.n::bigint as n_bytes, coalesce(removed, 0)::bigint as n_removed, coalesce(spans, 0)::bigint as n_spans,
               case when t.doc_id is null then sha256(b) else sha256(unhex(coalesce(kept, ''))) end as kept_sha256
        from n left join t using (doc_id) left join p using (doc_id)
    """,
    "op11_merkle_manifest": f"""
        with recursive d as (
          select doc_id, lang, sha256({_LEAF} || {_field("text")}) as leaf, sha256({_LEAF} || {_field(_LOW)}) as bad,
                 coalesce({_crc("doc_id::varchar")} % 3 = 0, false) as hit from documents),
        l as (select *, row_number() over (partition by lang order by doc_id nulls first, leaf) - 1 as i, count(*) over (partition by lang) as n from d),
        up(lang, n, lvl, i, h) as (
          select lang, n, 0, i, leaf from l
          union all select lang, (n + 7) // 8, lvl + 1, i // 8, sha256(string_agg(h, '' order by i)) from up where n > 1 group by lang, n, lvl, i // 8),
        top as (select lang, lvl, h, row_number() over (order by lang nulls first) - 1 as r, count(*) over () as m from up where n = 1),
        crown(n, lvl, i, h) as (
          select m, 0, r, h from top
          union all select (n + 7) // 8, lvl + 1, i // 8, sha256(string_agg(h, '' order by i)) from crown where n > 1 group by n, lvl, i // 8),
        kids as (
          select top.r as tree, up.lvl, up.i // 8 as run, list(up.h order by up.i) as hs from up join top on top.lang is not distinct from up.lang where up.n > 1 group by all
          union all select -1, lvl, i // 8, list(h order by i) from crown where n > 1 group by all),
        start as (select row_number() over () as k, l.*, top.r, top.h as subroot, top.lvl as depth from l join top on top.lang is not distinct from l.lang),
        climb(k, r, depth, tree, lvl, i, h, sib) as (
          select k, r, depth, r, 0, i, case when hit then bad else leaf end, '' from start
          union all
          select c.k, c.r, c.depth, coalesce(kids.tree, -1), case when kids.tree is null then 0 else c.lvl + 1 end, case when kids.tree is null then c.r else c.i // 8 end,
                 case when kids.tree is null then c.h else sha256(array_to_string(hs[1 : (c.i % 8)::int], '') || c.h || array_to_string(hs[(c.i % 8 + 2)::int :], '')) end,
                 case when kids.tree is null then c.sib else c.sib || array_to_string(hs[1 : (c.i % 8)::int], '') || array_to_string(hs[(c.i % 8 + 2)::int :], '') end
          from climb c left join kids on kids.tree = c.tree and kids.lvl = c.lvl and kids.run = c.i // 8
          where kids.tree is not null or c.tree >= 0),
        done as (select k, h, sib from climb where tree = -1 qualify row_number() over (partition by k order by lvl desc) = 1),
        root as (select h as root from crown where n = 1)
        select doc_id, leaf, subroot, root, sha256(sib) as proof_sha256, h as folded_root, h = root as verified from start join done using (k), root
    """,
    "op12_conversation_repair": rf"""
        with recursive o as (
          select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text,
                 {_crc("coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ')")} % 20 as k from conversations),
        d as (
          select conv_id, turn, case when k = 4 then 'user' else role end as role,
                 case k when 1 then '' when 2 then translate(text, '.!?', '') else text end as text
          from (select *, unnest(range(case when k = 3 then 2 else 1 end)) from o where k <> 0)),
        t as (
          select *, row_number() over (partition by conv_id, role, text order by j) > 1 as again,
                 rtrim(text, chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' ') as said, left(role, 1) as i,
                 left(role, 1) || lead(left(role, 1)) over (partition by conv_id order by j) as pair
          from (select *, row_number() over (partition by conv_id order by turn nulls first, role, sha256(octet_length(encode(role)) || ':' || role || text)) as j from d)),
        f as (
          select *, said = '' as blank, said <> '' and again as duplicate, said <> '' and not again and right(said, 1) not in ('.', '!', '?') as short,
                 said = '' or again as goes, case when said <> '' and not again and right(said, 1) not in ('.', '!', '?') then 1 else 0 end as cut from t),
        z as (
          select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) filter (blank) as blank, count(*) filter (duplicate) as duplicate,
                 count(*) filter (short) as truncated, count(*) filter (pair not in ('su', 'ua', 'au')) as illegal, count(*) as n from f group by conv_id),
        x(conv_id, j, e, s, u, a) as (
          select conv_id, 0, {{'c': 0, 'a': ''}}, null::struct(c integer, a varchar), {{'c': 2, 'a': 'I'}}, {{'c': 4, 'a': 'II'}} from z
          union all
          select conv_id, j, {_repair()[1]} from (
            select conv_id, j, {_repair()[1]} from (
              select x.conv_id, f.j, {_repair()[0]} from x join f on f.conv_id is not distinct from x.conv_id and f.j = x.j + 1))),
        b as (select z.*, {_least("e", "a")} as best from z join x on x.conv_id is not distinct from z.conv_id and x.j = z.n),
        p as (select conv_id, best.a as audit, unnest(generate_series(1, length(best.a))) as q from b),
        e as (
          select conv_id, q, audit[q] as edit, audit, length(replace(audit[1 : q], 'I', '')) as j, length(replace(audit[1 : q], 'D', '')) - 1 as m,
                 length(replace(audit, 'D', '')) % 2 as odd from p),
        r as (
          select e.conv_id, string_agg(case when edit = 'K' then f.role when (m - odd) % 2 = 0 then 'user' else 'assistant' end || ':' || case when edit = 'I' then '' else f.text end, chr(10) order by q) as said
          from e left join f on f.conv_id is not distinct from e.conv_id and f.j = e.j where edit <> 'D' group by e.conv_id)
        select c.conv_id, coalesce(gaps, 0)::bigint as gaps, coalesce(blank, 0)::bigint as blank, coalesce(duplicate, 0)::bigint as duplicate, coalesce(truncated, 0)::bigint as truncated,
               coalesce(illegal, 0)::bigint as illegal, coalesce(best.c, 0)::bigint as cost, coalesce(best.a, '') as audit, sha256(coalesce(said, '')) as repaired_sha256
        from (select distinct conv_id from conversations) c left join b on b.conv_id is not distinct from c.conv_id left join r on r.conv_id is not distinct from c.conv_id
    """,
    "license_base": r"""
        with w as (select row_number() over () as r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
        p as (select unnest([{'p': 'under the mit license', 'l': 'mit'}, {'p': 'apache license version 2', 'l': 'apache-2'}, {'p': 'cc by nc', 'l': 'cc-by-nc'}], recursive := true)),
        h as (select r, l, unnest(range(len(w))) as i, w, string_split(p, ' ') as q from w, p where list_contains(w, string_split(p, ' ')[1])),
        b as (select r, l, i from h where w[i + 1 : i + len(q)] = q)
        select doc_id, len(any_value(w))::bigint as n_words, count(b.i) as n_base, min(b.i)::bigint as first_word, max(b.i)::bigint as last_word,
               coalesce(string_agg(distinct l, ',' order by l), '') as base_labels
        from w left join b using (r) group by w.r, doc_id
    """,
    "quality_folds": _folds(4, 2),
    "language_folds": _folds(3, 1),
    "edited_texts": """
        with d as (select doc_id, coalesce(text, '') as t, length(coalesce(text, '')) as n from documents),
        o as (select *, coalesce(lead(t) over (order by doc_id desc), first_value(t) over (order by doc_id desc)) as x from d)
        select doc_id, n::bigint as n_chars, sha256(left(t, (n - n // 3)::int) || left(x, (n // 3)::int)) as edited_sha256 from o
    """,
    "decoded_pieces": "select doc_id, octet_length(encode(coalesce(text, '')))::bigint as n_bytes, sha256(coalesce(text, '')) as decoded_sha256 from documents",
    "private_base_spans": r"""
        with d as (select row_number() over () as r, doc_id, translate(coalesce(text, ''), chr(1) || chr(2), '  ') as t from documents),
        m as (
          select r, 1 as o, 'email' as kind, regexp_replace(t, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+', chr(1) || '\0' || chr(2), 'g') as m from d
          union all select r, 2, 'ip', regexp_replace(t, '[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)', chr(1) || '\0' || chr(2), 'g') from d
          union all select r, 3, 'card', regexp_replace(t, '[0-9]([\x20-]?[0-9])+', chr(1) || '\0' || chr(2), 'g') from d
          union all select r, 4, 'phone', regexp_replace(t, '\+[0-9][\x20().0-9-]+[0-9]', chr(1) || '\0' || chr(2), 'g') from d),
        p as (select r, o, kind, unnest(string_split(m, chr(1))) as part, generate_subscripts(string_split(m, chr(1)), 1) as j from m),
        h as (select r, o, kind, j, split_part(part, chr(2), 1) as hit,
                     sum(length(replace(part, chr(2), ''))) over (partition by r, o order by j) - length(replace(part, chr(2), '')) as a from p),
        s as (select *, regexp_replace(hit, '[^0-9]', '', 'g') as n from h where j > 1),
        k as (select r, o, kind, a::bigint as a, (a + length(hit))::bigint as z from s
              where kind = 'email'
                 or kind = 'ip' and list_max(list_transform(string_split(hit, '.'), lambda x: case when length(ltrim(x, '0')) > 3 then 999 else ('0' || ltrim(x, '0'))::int end)) <= 255
                 or kind = 'card' and length(n) between 16 and 19
                    and list_sum(list_transform(range(length(n)), lambda i: (('0' || reverse(n)[i + 1])::int * (1 + i % 2)) - case when ('0' || reverse(n)[i + 1])::int * (1 + i % 2) > 9 then 9 else 0 end)) % 10 = 0
                 or kind = 'phone' and length(n) between 8 and 15)
        select d.doc_id, count(*) filter (kind = 'email')::bigint as n_email, count(*) filter (kind = 'ip')::bigint as n_ip,
               count(*) filter (kind = 'card')::bigint as n_card, count(*) filter (kind = 'phone')::bigint as n_phone,
               sha256(coalesce(string_agg(kind || ':' || a || ':' || z, ',' order by o, a), '')) as base_sha256
        from d left join k using (r) group by d.r, d.doc_id
    """,
}
