import time
from collections import defaultdict

from sparkassay.llm import lines

FOOT = "All rights reserved."


def brute(rows, min_sites=lines.MIN_SITES, own=lines.OWN_PERCENT):
    def worded(text):
        return [x for x in (text or "").split("\n") if x.strip(" \t\n\v\f\r")]

    def wide(some):
        sites = defaultdict(set)
        for _, text, _, site in some:
            for x in worded(text):
                sites[x] |= {site} - {None}
        return {x for x in sites if len(sites[x]) >= min_sites}

    shared = wide(rows)

    def witness(text):
        size = [(len(x), x in shared) for x in worded(text)]
        return 100 * sum(n for n, s in size if not s) >= own * sum(n for n, _ in size)

    bad = wide([r for r in rows if witness(r[1])]) & shared
    return sorted(((i, t if t is None else "\n".join(x for x in t.split("\n") if x not in bad)) for i, t, _, _ in rows), key=str)


def table(n, copies=0, sites=12):
    rows = [(i, f"Text {i} begins.\n{FOOT}\nMore of {i}.\n\nLast.", "en", f"s{i % sites}") for i in range(n)]
    rows += [(n + i, "A copied line.\nAnother copied line.\nThe end of it.", "en", f"s{i % sites}") for i in range(copies)]
    return rows + [(9000, None, "en", "s1"), (9001, "", "en", None), (9002, FOOT, None, None)]


def test_boilerplate_goes_and_copies_stay(docs):
    rows = table(40, copies=60)
    out = lines.remove_boilerplate(docs(rows), report=True)
    assert sorted(((r["doc_id"], r["text"]) for r in out.collect()), key=str) == brute(rows)
    kept = {r["doc_id"]: r for r in out.collect()}
    assert FOOT not in kept[3]["text"] and kept[41]["text"].startswith("A copied line.")
    assert kept[3]["n_removed"] == 2 and kept[3]["n_lines"] == 5  # the footer and "Last.", whose neighbours never change
    assert kept[3]["text"] == "Text 3 begins.\nMore of 3.\n" and kept[9000]["text"] is None


def test_near_the_threshold(docs):
    for sites in range(lines.MIN_SITES - 2, lines.MIN_SITES + 3):
        rows = table(24, sites=sites)
        out = lines.remove_boilerplate(docs(rows))
        assert sorted(((r["doc_id"], r["text"]) for r in out.collect()), key=str) == brute(rows)
        assert out.columns == docs(rows).columns


def told(out):
    return sorted(((r["doc_id"], r["text"]) for r in out.collect()), key=str)


def test_a_footer_of_many_lines_goes_whole(docs):
    foot = "Imprint and contact\nAll rights reserved.\nTerms of use"
    rows = [(i, f"Text {i} has words of its own.\nMore of {i}, and a bit of {i * 7}.\n{foot}", "en", f"s{i % 20}") for i in range(400)]
    found = told(lines.remove_boilerplate(docs(rows)))
    assert found == brute(rows)
    assert not any(x in t for _, t in found for x in foot.split("\n"))


def test_copies_neither_protect_a_footer_nor_become_one(docs):
    rows = [(i, f"Text {i} has words of its own.\nMore of {i}.\n{FOOT}", "en", f"s{i % 51}") for i in range(300)]
    copy = f"A page that was copied widely.\nIts second line stays as well.\n{FOOT}"
    rows += [(1000 + i, copy, "en", f"s{i % 51}") for i in range(1000)]
    near = [f"Sentence {j} of a page with many near copies." for j in range(12)]
    for i in range(300):
        text = [*near[: i % 12], f"Sentence changed in {i}.", *near[i % 12 + 1 :]]
        rows.append((3000 + i, "\n".join(text), "en", f"s{i % 51}"))
    found = told(lines.remove_boilerplate(docs(rows)))
    assert found == brute(rows)
    kept = dict(found)
    assert not any(FOOT in t for t in kept.values())
    assert all(kept[1000 + i] == copy.removesuffix("\n" + FOOT) for i in range(1000))
    assert all(kept[3000 + i].count("\n") == 11 for i in range(300))


def test_a_text_of_many_lines_takes_linear_time(docs):
    long = "\n".join(x for j in range(200_000) for x in (f"own line {j}", FOOT))
    rows = [*table(24), (5000, long, "en", "s1")]
    begin = time.time()
    found = told(lines.remove_boilerplate(docs(rows, clash=False)))
    assert time.time() - begin < 60
    assert dict(found)[5000].count("\n") == 199_999 and FOOT not in dict(found)[5000]


def test_edges(edge, empty):
    out = lines.remove_boilerplate(edge)
    assert sorted(map(str, out.select("doc_id", "text").collect())) == sorted(map(str, edge.select("doc_id", "text").collect()))
    assert lines.remove_boilerplate(empty).collect() == []


def test_no_python_in_the_plan(docs):
    plan = lines.remove_boilerplate(docs(table(9)))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
