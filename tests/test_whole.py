"""Queries that cover their whole table, on small tables whose rows lie where a part would not reach."""

from collections import defaultdict

from quire.plans.registry import QUERIES


def test_adjacency_covers_orders_of_any_key(spark, tmp_path):
    rows = [(k, n, "AB"[k % 2]) for k in (1, 14, 2000, 2001, 2015, 7_000_000_007) for n in (1, 2, 3, 4)]
    spark.createDataFrame(rows, "l_orderkey bigint, l_linenumber int, l_returnflag string").write.parquet(str(tmp_path / "lineitem.parquet"))
    out, inc, counts = defaultdict(list), defaultdict(list), defaultdict(lambda: [set(), 0, 0])
    for k, n, flag in rows:
        out[k % 7, f"b{k}"].append(f"r-{k}-{n}")
        types = counts[k % 7]
        types[0].add(flag)
        types[1] += 1
        if n % 4:
            inc[k % 7, f"b{k + n * 7}"].append(f"r-{k}-{n}")
            types[2] += 1
    want = {(*key, ",".join(sorted(out[key])), ",".join(sorted(inc[key]))) for key in set(out) | set(inc)}
    assert {tuple(r) for r in QUERIES["adjacency_all"](spark, str(tmp_path)).collect()} == want
    want = {(d, ",".join(sorted(t)), n, resolved) for d, (t, n, resolved) in counts.items()}
    assert {tuple(r) for r in QUERIES["counts_by_type_all"](spark, str(tmp_path)).collect()} == want


def test_a_band_line_recurs_as_a_whole(spark, tmp_path):
    pages = [
        ["The Book, page 12", "x", "y", "end of a"],
        ["The  book page 7", "x", "y", "End of b"],  # the first line but for case, marks, space and digits
        ["The bookends", "x", "y", "The Book, page 3"],  # the same start, another line; the line in the other band
        ["Solo", "x", "y", "END OF B!"],
        ["!", "", "", "?"],  # nothing to compare
        ["!", "", "", "The booking"],
        ["Solo"],  # three away; both bands
        ["Solo"],
    ]
    text = "\n".join(line for page in pages[:-2] for line in page) + "\nSolo\n\n\n\nSolo"
    rows = [(1, text), (2, None), (3, ""), (4, "The Book, page 12"), (5, text.replace("Solo", "Sole"))]
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {tuple(r) for r in QUERIES["band_line_recurrence"](spark, str(tmp_path)).select("doc_id", "page", "band", "key", "step").collect()}
    book = "the book page #"
    want = {(0, "top", book, 1), (1, "top", book, -1), (1, "bottom", "end of b", 2), (3, "bottom", "end of b", -2)}
    want |= {(p, b, "solo", s) for p, s in ((6, 1), (7, -1)) for b in ("top", "bottom")}
    assert got == {(d, p, b, k.replace("solo", "sole") if d == 5 else k, s) for d in (1, 5) for p, b, k, s in want}


def test_blocks_of_every_chunk_are_resolved(spark, tmp_path):
    ids = [-3, 0, 1, 25, 26, 50, 51, 176, 200, 201, 7_000_000_007]
    spark.createDataFrame([(i, f"l{i}", "s") for i in ids], "doc_id bigint, lang string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    chunk = {i: (max(i, 1) - 1) // 25 for i in ids}
    first = {i: min(j for j in ids if chunk[j] == chunk[i]) for i in ids}
    got = QUERIES["chunk_firsts"](spark, str(tmp_path)).collect()
    assert sorted(tuple(r) for r in got) == [(i, f"l{i}", "s", chunk[i], first[i], f"l{first[i]}") for i in ids]
