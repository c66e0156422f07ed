"""Queries over the documents table: profiles, quality, repeated lines, words, search, markers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import text as T
from quire.functions.stats import first_mode, low_quantile, percent, top_percentile, upper_median
from quire.operators import graph, lexicon
from quire.operators.graph import chunk_of
from quire.operators.phrases import contained
from quire.plans.common import LINES, table, texts
from quire.sources.texts import document_lines

Q, O = {}, {}


def _lines(spark: SparkSession, sf: str) -> DataFrame:
    return document_lines(texts(spark, sf))


def doc_lines_profile(spark, sf):
    lines = _lines(spark, sf).withColumn("len", F.length("line"))
    mode = first_mode(lines, ["doc_id"], "len", "line_no", 10.0, "mode_len")
    v = F.col("v")
    per = lines.groupBy("doc_id").agg(F.collect_list(F.col("len").cast("double")).alias("v"), F.median("len").alias("true_median"))
    per = per.select("doc_id", F.size("v").cast("bigint").alias("n_lines"), top_percentile(v, 0.9).alias("p90_len"), low_quantile(v, 0.9).alias("q90_len"), upper_median(v).alias("upper_median_len"), F.col("true_median").cast("double").alias("median_len"))
    return per.join(mode.withColumn("mode_len", F.col("mode_len").cast("double")), "doc_id")


Q["doc_lines_profile"] = doc_lines_profile
O["doc_lines_profile"] = f"""
    with {LINES},
    l as (select doc_id, line_no, length(line)::double as len from lines),
    b as (select doc_id, floor(len / 10 + 0.5) * 10 as bin, count(*) as n, min(line_no) as first from l group by all),
    m as (select doc_id, bin as mode_len from b qualify row_number() over (partition by doc_id order by n desc, first) = 1),
    v as (select doc_id, list_sort(list(len)) as v, median(len) as median_len from l group by doc_id)
    select v.doc_id, len(v)::bigint as n_lines, v[least(len(v) - 1, floor(len(v) * 0.9))::bigint + 1] as p90_len,
           v[greatest(0, least(len(v) - 1, floor(0.9 * (len(v) - 1))))::bigint + 1] as q90_len, v[floor(len(v) / 2)::bigint + 1] as upper_median_len,
           median_len::double as median_len, mode_len::double as mode_len
    from v join m using (doc_id)"""


def text_quality(spark, sf):
    return texts(spark, sf).select("doc_id", T.quality(F.col("text")).alias("quality"))


_QUALITY = rf"""
    t as (select doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) as s from documents),
    c as (select doc_id, s, list_filter(list_transform(string_split(s, ' '), lambda w: regexp_replace(w, '[^\p{{L}}]', '', 'g')), lambda w: w <> '') as cores from t),
    r as (select doc_id, s, length(s) as n, length(regexp_replace(s, '[^\p{{L}}]', '', 'g')) as letters,
                 length(regexp_replace(s, '[^\x{{FFFD}}\x{{E000}}-\x{{F8FF}}\x00-\x1F]', '', 'g')) as bad, len(cores) as words,
                 len(list_filter(cores, lambda w: length(w) <= 24 and regexp_matches(lower(w), '{T.VOWELS}'))) as sane from c),
    quality as (select doc_id, n, case when n > 0 then floor(least(1.0, greatest(0.0, letters::double / n * 0.4 + (1 - bad::double / n) * 0.2
                 + case when words > 0 then sane::double / words else 0.0 end * 0.4)) * 100 + 0.5) / 100 else 0.0 end as quality from r)"""

Q["text_quality"] = text_quality
O["text_quality"] = f"with {_QUALITY} select doc_id, quality::double as quality from quality"


def page_class(spark, sf):
    docs = texts(spark, sf).select("doc_id", T.quality(F.col("text")).alias("quality"), F.length(T.squeezed(F.col("text"))).cast("bigint").alias("chars"))
    kind = T.page_kind(F.col("chars"), F.col("quality"))
    return docs.select("doc_id", "chars", "quality", kind.alias("kind"), F.when(kind == "native", "native").otherwise("ocr").alias("method"))


_CLASS = f"{_QUALITY}, classes as (select doc_id, n::bigint as chars, quality::double as quality, case when n < 60 then 'scanned' when quality < 0.55 then 'poor_native' else 'native' end as kind from quality)"
Q["page_class"] = page_class
O["page_class"] = f"with {_CLASS} select *, case when kind = 'native' then 'native' else 'ocr' end as method from classes"


def doc_kind(spark, sf):
    pages = page_class(spark, sf).join(texts(spark, sf).select("doc_id", "source"), "doc_id")
    native, ocr = F.count_if(F.col("method") == "native"), F.count_if(F.col("method") == "ocr")
    kind = F.when((ocr == 0) & (native == 0), "empty").when(ocr == 0, "native-text").when(native == 0, "scanned").otherwise("mixed")
    return pages.groupBy("source").agg(native.alias("native_pages"), ocr.alias("ocr_pages"), kind.alias("kind"))


Q["doc_kind"] = doc_kind
O["doc_kind"] = f"""with {_CLASS}, m as (select source, count(*) filter (kind = 'native') as native_pages, count(*) filter (kind <> 'native') as ocr_pages
    from classes join documents using (doc_id) group by source)
    select *, case when ocr_pages = 0 and native_pages = 0 then 'empty' when ocr_pages = 0 then 'native-text' when native_pages = 0 then 'scanned' else 'mixed' end as kind from m"""


def _repeated(spark, sf):
    lines = _lines(spark, sf).where((F.length("line") <= 45) & ~F.col("line").rlike(T.STRUCTURAL)).withColumn("key", T.shape_key(F.col("line")))
    docs = texts(spark, sf).agg(F.count("*").alias("docs"))
    groups = lines.groupBy("key").agg(F.count("*").alias("n"), F.bool_and(F.col("line").rlike(T.NUMERAL_LINE)).alias("numeric"))
    # One row: how many documents there are.
    return lines, groups.join(F.broadcast(docs)).where(F.col("n") >= F.greatest(F.lit(8.0), F.col("docs") * 0.01))


def repeated_lines(spark, sf):
    _, many = _repeated(spark, sf)
    return many.select("key", "n", F.when(F.col("numeric"), "printed-page-number").otherwise("repeated-boilerplate").alias("classification"))


_REPEATED = rf"""{LINES}, k as (select *, lower(regexp_replace(line, '[0-9]+', '#', 'g')) as key from lines where length(line) <= 45
      and not regexp_matches(line, '(?i)^(book|volume|part|chapter|canto|act|section)\s+([0-9]+|[ivxlcdm]+|[a-z-]+)$')),
    many as (select key, count(*) as n, bool_and(regexp_matches(line, '^[\s.\-–—\[\]()]*([0-9]{{1,4}}|[ivxlcdm]{{1,7}}|[IVXLCDM]{{1,7}})[\s.\-–—\[\]()]*$')) as numeric
      from k group by key having count(*) >= greatest(8.0, (select count(*) from documents) * 0.01))"""
Q["repeated_lines"] = repeated_lines
O["repeated_lines"] = f"with {_REPEATED} select key, n, case when numeric then 'printed-page-number' else 'repeated-boilerplate' end as classification from many"


def kept_lines(spark, sf):
    lines, many = _repeated(spark, sf)
    killed = lines.join(many, "key", "left_semi").select("doc_id", "line_no")
    kept = _lines(spark, sf).join(killed, ["doc_id", "line_no"], "left_anti")
    return kept.groupBy("doc_id").agg(F.count("*").alias("kept"), F.sum(F.length("line")).alias("kept_chars"))


Q["kept_lines"] = kept_lines
O["kept_lines"] = f"""with {_REPEATED}, dead as (select doc_id, line_no from k where key in (select key from many))
    select doc_id, count(*) as kept, sum(length(line))::bigint as kept_chars from lines l where not exists (select 1 from dead d where d.doc_id = l.doc_id and d.line_no = l.line_no) group by doc_id"""

Q["lexicon_words"] = lambda spark, sf: lexicon.words(_lines(spark, sf), [])
O["lexicon_words"] = f"with {LINES}, w as (select unnest(list_transform(regexp_extract_all(line, '{lexicon.WORD.replace(chr(39), chr(39) * 2)}'), lambda x: lower(x))) as word from lines) select word, count(*) as n from w where length(word) >= 2 group by word"

_SEQ = f"seq as (select regexp_extract_all(lower(line), '{lexicon.LOWER_WORD.replace(chr(39), chr(39) * 2)}') as s from lines), pairs as (select unnest(list_zip(s[1:len(s) - 1], s[2:])) as p from seq where len(s) >= 2), bigrams as (select p[1] as a, p[2] as b, count(*) as n from pairs group by all)"
Q["lexicon_bigrams"] = lambda spark, sf: lexicon.bigrams(_lines(spark, sf), [])
O["lexicon_bigrams"] = f"with {LINES}, {_SEQ} select a, b, n from bigrams"

Q["hyphenated_compounds"] = lambda spark, sf: lexicon.compounds(_lines(spark, sf), [])
O["hyphenated_compounds"] = f"with {LINES}, c as (select unnest(regexp_extract_all(lower(line), '[a-zÀ-ɏ]{{2,}}[-‐][a-zÀ-ɏ]{{2,}}')) as c from lines) select distinct replace(c, '‐', '-') as compound from c"

Q["deglue_candidates"] = lambda spark, sf: lexicon.fused_words(_lines(spark, sf), [])
O["deglue_candidates"] = f"""with {LINES}, {_SEQ},
    w as (select unnest(list_transform(regexp_extract_all(line, '{lexicon.WORD.replace(chr(39), chr(39) * 2)}'), lambda x: lower(x))) as word from lines),
    long_words as (select word from w where length(word) between 11 and 28 and not contains(word, '''') group by word having count(*) <= 1),
    cut as (select word, unnest(range(3, length(word) - 2)) as place from long_words),
    hits as (select word, place, a, b, n from cut join bigrams on a = substr(word, 1, place) and b = substr(word, place + 1) where n >= 4)
    select word, a as "left", b as "right", n from hits qualify row_number() over (partition by word order by n desc, place) = 1"""


def line_joiners(spark, sf):
    lines = _lines(spark, sf)
    return lexicon.joiners(lines, lexicon.compounds(lines, ["doc_id"]), lexicon.SHORT_WORDS)


_SHORT = ", ".join(f"'{w}'" for w in lexicon.SHORT_WORDS)
Q["line_joiners"] = line_joiners
O["line_joiners"] = f"""with {LINES}, comp as (select distinct doc_id, replace(c, '‐', '-') as compound from (select doc_id, unnest(regexp_extract_all(lower(line), '[a-zÀ-ɏ]{{2,}}[-‐][a-zÀ-ɏ]{{2,}}')) as c from lines)),
    p as (select doc_id, line_no, line as next, lag(line) over (partition by doc_id order by line_no) as prev from lines),
    h as (select *, regexp_matches(prev, '[-‐]$') and regexp_matches(next, '^[a-z]') as hyphen,
          lower(regexp_extract(prev, '([A-Za-zÀ-ɏ]+)[-‐]$', 1)) || '-' || lower(regexp_extract(next, '^([a-zÀ-ɏ]+)', 1)) as compound,
          regexp_replace(lower(regexp_extract(prev, '([A-Za-z’'']+)$', 1)), '[’'']', '', 'g') as tail from p where prev is not null)
    select h.doc_id, line_no, case when hyphen then case when comp.compound is not null then '-' else '' end
           when regexp_matches(next, '^[a-z]') and tail <> '' and length(tail) <= 2 and tail not in ({_SHORT}) then '' else ' ' end as joiner
    from h left join comp on comp.doc_id = h.doc_id and comp.compound = h.compound and hyphen"""


def search_snippets(spark, sf, q: str = "ndthat"):
    docs = texts(spark, sf).withColumn("at", F.instr(F.lower("text"), q) - 1).where("at >= 0")
    return docs.select("doc_id", F.col("at").cast("bigint").alias("at"), T.snippet(F.col("text"), F.col("at"), len(q)).alias("snippet"))


Q["search_snippets"] = search_snippets
O["search_snippets"] = """with h as (select doc_id, text, instr(lower(text), 'ndthat') - 1 as p from documents where instr(lower(text), 'ndthat') > 0)
    select doc_id, p::bigint as "at", substr(text, greatest(0, p - 60)::bigint + 1, p + 86 - greatest(0, p - 60)::bigint) as snippet from h"""



def search_hits(spark, sf, q: str = "the"):
    """Documents as blocks: the first hits of a search, as a reader is shown them."""
    docs = texts(spark, sf).where("doc_id is not null")
    return graph.search(docs.select("doc_id", F.col("doc_id").alias("block_id"), F.col("doc_id").alias("ord"), "text"), q)


Q["search_hits"] = search_hits
O["search_hits"] = """with h as (select doc_id, text, instr(lower(text), 'the') - 1 as p from documents where instr(lower(text), 'the') > 0 order by doc_id limit 200)
    select doc_id, doc_id as block_id, substr(text, greatest(0, p - 60)::bigint + 1, p + 83 - greatest(0, p - 60)::bigint) as snippet from h"""

Q["chunk_partition"] = lambda spark, sf: texts(spark, sf).groupBy(chunk_of(F.col("doc_id")).cast("bigint").alias("chunk")).agg(F.count("*").alias("docs"), F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc"))
O["chunk_partition"] = "select ((greatest(doc_id, 1) - 1) // 25)::bigint as chunk, count(*) as docs, min(doc_id) as first_doc, max(doc_id) as last_doc from documents group by 1"



def chunk_lookup(spark, sf):
    """Chunks as directories: every document with the chunk that holds it, found again from the chunk's range."""
    docs = texts(spark, sf).where("doc_id is not null").withColumn("chunk", chunk_of(F.col("doc_id")).cast("bigint"))
    ranges = docs.groupBy("chunk").agg(F.count("*").alias("held"))
    return docs.join(ranges, "chunk").select("doc_id", "lang", "source", "chunk", "held")


Q["chunk_lookup"] = chunk_lookup
O["chunk_lookup"] = "select doc_id, lang, source, ((greatest(doc_id, 1) - 1) // 25)::bigint as chunk, count(*) over (partition by (greatest(doc_id, 1) - 1) // 25) as held from documents where doc_id is not null"


def chunk_firsts(spark, sf):
    """Every document with the first document of its chunk."""
    docs = texts(spark, sf).withColumn("chunk", chunk_of(F.col("doc_id")).cast("bigint"))
    firsts = docs.groupBy("chunk").agg(F.min("doc_id").alias("first_doc"))
    found = firsts.join(docs.select(F.col("doc_id").alias("first_doc"), F.col("lang").alias("first_lang")), "first_doc")
    return docs.join(found, "chunk").select("doc_id", "lang", "source", "chunk", "first_doc", "first_lang")


Q["chunk_firsts"] = chunk_firsts
O["chunk_firsts"] = """with d as (select doc_id, lang, source, ((greatest(doc_id, 1) - 1) // 25)::bigint as chunk from documents), f as (select chunk, min(doc_id) as first_doc from d group by 1)
    select d.doc_id, d.lang, d.source, d.chunk, f.first_doc, a.lang as first_lang from d join f using (chunk) join d a on a.doc_id = f.first_doc"""


def _glued(spark, sf):
    return texts(spark, sf).select("doc_id", F.explode(T.glued_symbols(F.col("text"))).alias("symbol"))


Q["glued_symbol_markers"] = lambda spark, sf: _glued(spark, sf).groupBy("doc_id", "symbol").agg(F.count("*").alias("n"))
O["glued_symbol_markers"] = r"""with m as (select doc_id, unnest(regexp_extract_all(text, '[\p{L}\p{N}.,;:!?''"’”)\]](\*{1,3}|†{1,3}|‡{1,3}|§{1,3}|¶{1,3})([^\p{L}\p{N}*†‡§¶]|$)', 1)) as symbol from documents)
    select doc_id, symbol, count(*) as n from m group by all"""


def _parens(spark, sf):
    return texts(spark, sf).select("doc_id", F.posexplode(F.regexp_extract_all("text", F.lit(r"\(([0-9]{1,3})\)"), F.lit(1))).alias("pos", "key"))


def marker_census(spark, sf):
    glued = _glued(spark, sf).select(F.lit("glued").alias("setting"), F.col("symbol").alias("key"))
    both = glued.unionByName(_parens(spark, sf).select(F.lit("parenthesized").alias("setting"), "key"))
    return both.groupBy("setting", T.marker_class(F.col("key")).alias("class")).agg(F.count("*").alias("n"))


Q["marker_census"] = marker_census
O["marker_census"] = r"""with m as (select 'glued' as setting, 'symbol' as class, unnest(regexp_extract_all(text, '[\p{L}\p{N}.,;:!?''"’”)\]](\*{1,3}|†{1,3}|‡{1,3}|§{1,3}|¶{1,3})([^\p{L}\p{N}*†‡§¶]|$)', 1)) as key from documents
    union all select 'parenthesized', 'numeric', unnest(regexp_extract_all(text, '\(([0-9]{1,3})\)', 1)) from documents) select setting, class, count(*) as n from m group by all"""

Q["paren_markers"] = lambda spark, sf: _parens(spark, sf).select("doc_id", F.col("pos").cast("bigint").alias("pos"), F.col("key").cast("bigint").alias("number"))
O["paren_markers"] = r"with p as (select doc_id, regexp_extract_all(text, '\(([0-9]{1,3})\)', 1) as ks from documents) select doc_id, unnest(range(len(ks)))::bigint as pos, unnest(ks)::bigint as number from p"


def stage_metrics(spark, sf):
    d = texts(spark, sf)
    text = F.col("text")
    glued, bad, broken = text.rlike("[a-z]{2}[.,;!?”][A-Za-z]"), text.rlike(r"[\x00\x{FFFD}]"), text.rlike(r"[A-Za-z0-9_]-\s[A-Za-z0-9_]")
    filled = F.count_if(F.length(F.trim("text")) > 0)
    per = d.groupBy("source").agg(F.count("*").alias("pages"), filled.alias("pages_with_text"), F.count_if(glued).alias("glued"), F.count_if(bad).alias("undecodable"), F.count_if(broken).alias("hyphenation"), F.sum(F.length("text")).alias("characters"))
    return per.withColumn("coverage_pct", percent(F.col("pages_with_text"), F.col("pages"))).withColumn("status", F.when(F.col("coverage_pct") < 50, "failed").when(F.col("coverage_pct") < 92, "warn").when((F.col("undecodable") > 0) | (F.col("glued") > F.col("pages") * 0.01), "warn").otherwise("ok"))


Q["stage_metrics"] = stage_metrics
O["stage_metrics"] = r"""with m as (select source, count(*) as pages, count(*) filter (length(trim(text)) > 0) as pages_with_text, count(*) filter (regexp_matches(text, '[a-z]{2}[.,;!?”][A-Za-z]')) as glued,
      count(*) filter (regexp_matches(text, '[\x00\x{FFFD}]')) as undecodable, count(*) filter (regexp_matches(text, '[A-Za-z0-9_]-\s[A-Za-z0-9_]')) as hyphenation, sum(length(text))::bigint as characters from documents group by source),
    c as (select *, case when pages > 0 then floor(pages_with_text * 1000.0 / pages + 0.5) / 10.0 else 0.0 end::double as coverage_pct from m)
    select *, case when coverage_pct < 50 then 'failed' when coverage_pct < 92 then 'warn' when undecodable > 0 or glued > pages * 0.01 then 'warn' else 'ok' end as status from c"""


def readiness(spark, sf):
    rank = F.create_map(F.lit("failed"), F.lit(2), F.lit("warn"), F.lit(1), F.lit("ok"), F.lit(0))
    worst = stage_metrics(spark, sf).agg(F.max(F.element_at(rank, F.col("status"))).alias("worst"), F.count("*").alias("parts"))
    return worst.select("parts", F.when(F.col("worst") == 2, "unreadable").when(F.col("worst") == 1, "degraded").otherwise("ready").alias("readiness"))


Q["readiness"] = readiness
O["readiness"] = f"with s as ({O['stage_metrics']}) select count(*) as parts, case when bool_or(status = 'failed') then 'unreadable' when bool_or(status = 'warn') then 'degraded' else 'ready' end as readiness from s"


def contained_phrases(spark, sf):
    """Every item of benchmark, as a phrase, in every document that has 85 per cent of it in one run."""
    items = table(spark, sf, "benchmark").select("item_id", F.col("text").alias("phrase"))
    return contained(texts(spark, sf), items, "doc_id", "item_id")


Q["contained_phrases"] = contained_phrases
_FOLD = r"list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '')"
O["contained_phrases"] = rf"""
    with d as (select doc_id, ' ' || array_to_string({_FOLD}, ' ') || ' ' as t from documents where text is not null),
    w as (select item_id, {_FOLD} as words from benchmark where text is not null),
    q as (select item_id, words, len(words) as n, ceil(len(words) * 0.85 - 1e-9)::bigint as m from w where len(words) > 0),
    short as (select item_id, ' ' || array_to_string(words[k + 1:k + m], ' ') || ' ' as run from (select *, unnest(range(0, n - m + 1)) as k from q)),
    pairs as (select distinct item_id, doc_id from short join d on contains(t, run)),
    ends as (select *, unnest(range(k + m, n + 1)) as e from (select *, unnest(range(0, n - m + 1)) as k from q)),
    runs as (select item_id, n, k, e - k as size, ' ' || array_to_string(words[k + 1:e], ' ') || ' ' as run from ends),
    hits as (select item_id, doc_id, n, k, size, instr(t, run) as c, t from pairs join runs using (item_id) join d using (doc_id) where contains(t, run))
    select item_id, doc_id, n as n_words, size as n_matched, k as from_word, length(t[1:c]) - length(replace(t[1:c], ' ', '')) - 1 as at_word
    from hits qualify row_number() over (partition by item_id, doc_id order by size desc, k) = 1
"""
