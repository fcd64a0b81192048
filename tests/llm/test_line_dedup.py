from collections import defaultdict

import corpus_pipeline
from tests.llm.corpus import documents, frame
from weirspan.llm import line_dedup


def brute(rows, min_sites=3, long_words=50):
    """Rows are (doc_id, text, source); a document is its id and text."""
    seen, first = defaultdict(set), {}
    for doc, text, source in rows:
        for place, raw in enumerate((text or "").split("\n")):
            line = raw.strip(" \t\r\x0b\x0c")
            if len(line.split()) >= 3:
                long = len(line.split()) >= long_words
                seen[line, long].add((doc, text) if long else source)
                at = (doc is None, doc or 0, place)
                first[line] = min(first.get(line, (at, None)), (at, None))
    gone = {line for (line, long), sites in seen.items() if len(sites) >= (2 if long else min_sites)}
    out = []
    for doc, text, _ in rows:
        if not text:
            out.append((doc, text, 0))
            continue
        lines = text.split("\n")
        drop = [p for p, raw in enumerate(lines) if (s := raw.strip(" \t\r\x0b\x0c")) in gone and first[s][0] != (doc is None, doc or 0, p)]
        out.append((doc, "\n".join(x for p, x in enumerate(lines) if p not in drop), len(drop)))
    return out


order = lambda r: tuple((x is None, x) for x in r)


def test_equals_brute_force(spark):
    rows = [(i, t) for i, t in documents() if i not in (None, 98)]  # one text an id, so the first place is unique
    docs = frame(spark, rows)
    given = [(r.doc_id, r.text, r.source) for r in docs.collect()]
    found = line_dedup.remove_repeated_lines(docs)
    assert found.columns == [*docs.columns, "n_lines", "n_removed"]
    got = [(r.doc_id, r.text, r.n_removed) for r in found.collect()]
    assert sorted(got, key=order) == sorted(brute(given), key=order)


def test_awkward_rows_stay(spark):
    docs = frame(spark).withColumnRenamed("mark", "n_removed")
    found = line_dedup.remove_repeated_lines(docs)
    assert found.count() == docs.count()
    assert [r.text for r in found.where("doc_id = 90").collect()] == [None]


def test_a_short_line_needs_three_sites_and_stays_once(spark):
    rows = [(i, f"own {i}\na shared line\nthe near line", f"s{i % 3}") for i in range(9)] + [(20, "the near line\nx", "s0"), (21, "only two sites", "s0"), (22, "only two sites", "s1")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r.doc_id: r.text for r in line_dedup.remove_repeated_lines(docs).collect()}
    assert got[0] == "own 0\na shared line\nthe near line" and got[1] == "own 1" and got[20] == "x" and got[21] == got[22] == "only two sites"


def test_many_sites_are_sure_without_an_exact_count(spark):
    docs = spark.createDataFrame([(i, f"boiler plate text\nown {i}", f"site{i}") for i in range(300)], "doc_id long, text string, source string")
    assert line_dedup.remove_repeated_lines(docs).where("text like '%boiler%'").count() == 1


def test_lines_of_one_or_two_words_stay(spark):
    docs = spark.createDataFrame([(i, f"The end.\nOwn {i}", f"s{i}") for i in range(9)], "doc_id long, text string, source string")
    assert line_dedup.remove_repeated_lines(docs).where("text like 'The end.%'").count() == 9


def test_empty_table(spark):
    assert line_dedup.remove_repeated_lines(frame(spark, [])).collect() == []


def test_a_short_line_on_all_sites_goes_in_the_pipeline(spark):
    """'Read more' stands on all twenty sites, 'The end.' on four of them, too few for a quarter."""
    rows = [(i, f"Read more\n{'The end.' if i < 4 else f'x {i}'}\nOwn {i}", f"s{i}") for i in range(20)]
    docs = spark.createDataFrame([(*r, len(r[1])) for r in rows], "doc_id long, text string, source string, n_chars long")
    got = {r.doc_id: r.text for r in corpus_pipeline.remove_repeated_lines(spark, docs, "").collect()}
    assert got[0] == rows[0][1] and [got[i] for i in (1, 2, 3)] == [f"The end.\nOwn {i}" for i in (1, 2, 3)]
    assert got[4] == "x 4\nOwn 4" and got[19] == "x 19\nOwn 19"
