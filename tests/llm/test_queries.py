import pytest

from siftline.llm import queries as Q
from tests.conftest import DATA, same_rows


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_equals_sql(name, spark, duck):
    ours, theirs = same_rows(Q.queries()[name](spark, DATA), duck, Q.oracle_sql()[name])
    assert ours == theirs


def rows(spark, name):
    return Q.queries()[name](spark, DATA).collect()


def test_names(spark, duck):
    """One row for each name as typed, unless it is a canonical name; what is a name or alias but for case and marks is found."""
    got = {(r["field"], r["doc_no"], r["value"]): r["term_id"] for r in rows(spark, "p1_found")}
    plain = "regexp_replace(lower({}), '[^\\p{{L}}\\p{{N}}+#]', '', 'g')"
    forms = f"select field, form, term_id, canonical from (select case when kind = 'title' then 'current_title' else 'evidence' end as field, unnest(list_prepend(canonical, coalesce(aliases, []))) as form, term_id, canonical from terms)"
    typed = "select distinct 'current_title' as field, doc_no, current_title as value from profile where current_title is not null union select distinct 'evidence', doc_no, evidence from doc_terms where term_id is null and evidence is not null"
    every = set(duck.execute(f"select field, doc_no, value from ({typed}) t where not exists (select 1 from ({forms}) f where f.field = t.field and f.canonical = t.value)").fetchall())
    assert {k for k, t in got.items() if t == -1} <= every and set(got) == every
    for field, doc, value, term in duck.execute(f"select t.field, doc_no, value, min(term_id) from ({typed}) t join ({forms}) f on f.field = t.field and {plain.format('value')} = {plain.format('form')} where value <> canonical group by 1, 2, 3 having count(distinct term_id) = 1").fetchall():
        assert got[field, doc, value] == term
    assert 0.5 < sum(t > 0 for t in got.values()) / len(got) < 1
    assert {(r["field"], r["value"]): r["records"] for r in rows(spark, "p1_unmatched")} == {k: sum(1 for (f, _, v), t in got.items() if (f, v) == k and t == -1) for k in {(f, v) for (f, _, v), t in got.items() if t == -1}}


def test_personal_details_are_gone(spark, duck):
    """Lines with a sign of a detail that SQL can see are found; masked texts have none left and keep all other lines."""
    found = {(r["tbl"], r["rec_no"], r["line_no"], r["kind"]) for r in rows(spark, "p5_found")}
    lines = "(select 'docs' as tbl, doc_no as no, string_split(markdown, chr(10)) as ls from docs union all select 'raw_docs', raw_no, string_split(markdown, chr(10)) from raw_docs)"
    mails = set(duck.execute(f"select tbl, no, i from {lines}, unnest(range(1, len(ls) + 1)) as r(i) where regexp_matches(ls[i], '[\\w.+-]+@[a-z][\\w-]*\\.[a-z]{{2,}}')").fetchall())
    assert mails and mails <= {(t, n, i) for t, n, i, k in found if k == "email"}
    texts = {(t, n): "\n".join(ls) for t, n, ls in duck.execute(f"select * from {lines} where ls is not null").fetchall()}
    for name in ("p5_placeholders", "p5_surrogates"):
        seen = {(r["tbl"], r["rec_no"]): r["text"] for r in rows(spark, name) if r["text"] is not None}
        assert set(seen) == set(texts)
        for key, text in seen.items():
            old, new = texts[key].split("\n"), text.split("\n")
            assert len(old) == len(new)
            changed = {(*key, i) for i, (a, b) in enumerate(zip(old, new), 1) if a != b}
            assert changed == {x[:3] for x in found if x[:2] == key}


def test_units_have_a_likely_one(spark):
    from siftline.plans import preparation

    got = preparation.p4_units(spark, DATA).collect()
    assert got and all(r["posterior"] is None or 0 < r["posterior"] <= 1 for r in got)
    assert all(r["currency"] and r["period"] for r in got) and any(r["posterior"] is not None for r in got)


def test_survivors_keep_what_is_claimed(spark, duck):
    claims = {}
    for g, t in duck.execute("select dup_group, term_id from docs join doc_terms using (doc_no) where not coalesce(deleted, false) and term_id is not null and dup_group is not null").fetchall():
        claims.setdefault(g, set()).add(t)
    got = rows(spark, "p6_survivors")
    plain = {r["dup_group"]: r["text_doc_no"] for r in rows(spark, "p6_found")}
    assert got and all(set(r["terms"]) <= claims.get(r["grp"], set()) and plain[r["grp"]] == r["text_doc_no"] for r in got)


def test_pieces_make_up_the_text(spark, duck):
    texts = dict(duck.execute("select doc_no::bigint || ':-1', markdown from docs").fetchall()) | dict(duck.execute("select doc_no::bigint || ':' || c.idx, c.text from (select doc_no, unnest(chunks) as c from build_docs)").fetchall())
    by = {}
    for r in rows(spark, "p7_pieces"):
        by.setdefault(f"{r['doc_no']}:{r['idx']}", []).append(r)
    assert by
    for key, parts in by.items():
        parts.sort(key=lambda r: r["piece"])
        assert "".join(texts[key][r["core"] : r["end"]] for r in parts) == texts[key]
        assert all(r["text"] == texts[key][r["start"] : r["end"]] and r["tokens"] <= 350 for r in parts)


def test_leaks_hold_the_exact_ones(spark):
    exact = {(r["doc_id"], r["item_id"]) for r in rows(spark, "p8_found")}
    got = rows(spark, "p8_leaks")
    assert exact == {(r["doc_id"], r["item_id"]) for r in got if r["exact"]} and all(r["exact"] + r["reworded"] > 0 for r in got)


def test_tokenized_mix_equals_sql(spark, duck):
    """The SQL of the mix, but for the sizes, which are those of the tokenizer; its own are others."""
    from siftline.llm.tokens import Tokenizer

    tokenizer = Tokenizer(Q._ranks())
    duck.execute("create temp table sizes (doc_id bigint, n bigint)")
    duck.executemany("insert into sizes values (?, ?)", [(k, max(1, tokenizer.size(t))) for k, t in duck.execute("select distinct doc_id, text from documents where text is not null").fetchall()])
    size = "greatest(1, length(text) // 4)::bigint"
    for name, like in (("p9_tokenized", "p9_mix"), ("p9_tokenized_shares", "p9_shares")):
        sql = Q.oracle_sql()[like]
        assert sql.count(size) == 1
        ours, theirs = same_rows(Q.queries()[name](spark, DATA), duck, sql.replace(size, "(select max(n) from sizes where sizes.doc_id = d.doc_id)"))
        assert ours == theirs and ours != same_rows(Q.queries()[like](spark, DATA), duck, sql)[0]


def test_scores_of_pages(spark, duck):
    scores = {r["doc_id"]: r for r in rows(spark, "p10_scores")}
    assert set(scores) == {k for (k,) in duck.execute("select distinct doc_id from documents where text is not null").fetchall()}
    assert {r["doc_id"] for r in rows(spark, "p10_found")} == {k for k, r in scores.items() if r["share"] > 0.5} != set()
    assert all(0 <= r["share"] <= 1 and r["bits"] >= 0 for r in scores.values())


def test_nothing_else_needs_the_subpackage():
    import pathlib

    root = pathlib.Path(__file__).parents[2]
    for p in (root / "siftline").rglob("*.py"):
        if "llm" not in p.relative_to(root).parts:
            assert "llm" not in [w for line in p.read_text().splitlines() if "import" in line for w in line.replace(".", " ").split()]
