import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from cartweave.errors import FilterSyntaxError
from cartweave.operators.filters import apply_filters, compile_filter
from cartweave.plans import osmfilter as O
from cartweave.schema import conform

HEAD = "OSMFilter v0.2.0\n\n"
KEYS, VALUES = ["a", "b", "c d", "é"], ["", "1", "2"]


def body(text):
    return O.parse(HEAD + text).body


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("COMMIT", (O.Commit(),)),
        ("COMMITDROP", (O.Commit(), O.Drop())),
        ("\n\nDROP\n\n\n", (O.Drop(),)),
        ('SET "a" "b" # why\nRENAME "a" "b"\r\nKEEP "a", "b"\rDELETE "x"', (O.Set("a", "b"), O.Rename("a", "b"), O.Keep(("a", "b")), O.Delete(("x",)))),
        ('SET "a\\"b" "c\\u0041\nd"', (O.Set('a\\"b', "c\\u0041\nd"),)),
        ("# only\n", ()),
        ("TYPE node, way, node\n\tDROP", (O.Block(O.TypeIs(("node", "way", "node")), (O.Drop(),)),)),
        ('HAS "a" # c\n\t# comment\n\tEQUALS "b" "2"\n\t\tDROP\n\tCOMMIT\nDROP', (O.Block(O.Has("a"), (O.Block(O.Equals("b", "2"), (O.Drop(),)), O.Commit())), O.Drop())),
        ('HAS "a"\n\t# nothing', (O.Block(O.Has("a"), ()),)),
    ],
)
def test_grammar(text, want):
    assert body(text) == want


@pytest.mark.parametrize(
    "text",
    ['SET  "a" "b"', 'SET "a"', 'KEEP "a","b"', "COMMIT ", "COMMIT\t# x", "DROP x", 'HAS "a"\n\n\tDROP', 'HAS "a"\nDROP', 'HAS "a"', "TYPE area\n\tDROP", "set", "TYPE node,way\n\tDROP", 'SET "a\\q" "b"', "\tDROP", 'HAS "a" DROP'],
)
def test_mistakes(text):
    with pytest.raises(FilterSyntaxError):
        body(text)


def test_headers():
    for head in ("OSMFilter v0.2.0\n\n", "OSMFilter 0.2.0\n\n", "OSMFilter v0.2.0\r\n\r\n", "OSMFilter v0.2.0\r\r"):
        assert O.parse(head + "DROP").body == (O.Drop(),)
    assert O.parse("OSMFilter v0.2.0\n\n\n").body == ()
    with pytest.warns(UserWarning, match="9.1.0"):
        O.parse("OSMFilter v9.1.0\n\nDROP")
    for text in ("OSMFilter v0.2.0\n\n", "OSMFilter v0.2.0\nDROP", "OSMFilter v0.2\n\nDROP", " OSMFilter v0.2.0\n\nDROP", "DROP", ""):
        with pytest.raises(FilterSyntaxError):
            O.parse(text)


def test_escapes_may_be_decoded():
    text = HEAD + 'SET "a\\n\\u0041" "\\"\\\\\\/"'
    assert O.parse(text).body == (O.Set("a\\n\\u0041", '\\"\\\\\\/'),)
    assert O.parse(text, decode_escapes=True).body == (O.Set("a\nA", '"\\/'),)


def test_both_mistakes_are_told():
    with pytest.raises(FilterSyntaxError, match="(?s)OSMFilter.*line 4.*CEL"):
        compile_filter(HEAD + "DROP\nKEEP x\n")


selectors = st.one_of(st.builds(O.TypeIs, st.lists(st.sampled_from(["node", "way", "relation"]), min_size=1, max_size=2).map(tuple)), st.builds(O.Has, st.sampled_from(KEYS)), st.builds(O.Equals, st.sampled_from(KEYS), st.sampled_from(VALUES)))
keys = st.lists(st.sampled_from(KEYS), min_size=1, max_size=3).map(tuple)
modifiers = st.one_of(
    st.builds(O.Set, st.sampled_from(KEYS), st.sampled_from(VALUES)), st.builds(O.Set, st.sampled_from(KEYS), st.sampled_from(VALUES)), st.builds(O.Rename, st.sampled_from(KEYS), st.sampled_from(KEYS)), st.builds(O.Rename, st.sampled_from(KEYS), st.sampled_from(KEYS)),
    st.builds(O.Keep, keys), st.builds(O.Delete, keys), st.just(O.Commit()), st.just(O.Drop()),
)
statements = st.recursive(modifiers, lambda inner: st.builds(O.Block, selectors, st.lists(inner, min_size=1, max_size=4).map(tuple)), max_leaves=12)
programs = st.builds(O.Program, st.just("0.2.0"), st.lists(statements, min_size=1, max_size=6).map(tuple))


def written(body, level=0):
    quoted = lambda *s: " ".join(f'"{x}"' for x in s)
    out = []
    for s in body:
        match s:
            case O.Set(k, v):
                line = "SET " + quoted(k, v)
            case O.Rename(a, b):
                line = "RENAME " + quoted(a, b)
            case O.Keep(ks) | O.Delete(ks):
                line = type(s).__name__.upper() + " " + ", ".join(map(quoted, ks))
            case O.Block(sel, inner):
                head = "TYPE " + ", ".join(sel.types) if isinstance(sel, O.TypeIs) else "HAS " + quoted(sel.key) if isinstance(sel, O.Has) else "EQUALS " + quoted(sel.key, sel.value)
                line = head + "\n" + written(inner, level + 1)
            case _:
                line = type(s).__name__.upper()
        out.append("\t" * level + line)
    return "\n".join(out)


@settings(max_examples=200, deadline=None)
@given(programs)
def test_programs_read_back(program):
    assert O.parse(HEAD + written(program.body)) == program


@pytest.fixture(scope="module")
def elements(spark):
    r = random.Random(1)
    rows = [(r.choice(["node", "way", "relation"]), i, {k: r.choice(VALUES) for k in [*KEYS, "other"] if r.random() < 0.6}) for i in range(120)]
    return conform(spark.createDataFrame(rows, "type string, id long, tags map<string,string>").repartition(3)).cache()


def result(frame):
    return {r["id"]: r["tags"] for r in frame.collect()}


@settings(max_examples=40, deadline=None)
@given(programs)
def test_expressions_as_the_interpreter(elements, program):
    want = {}
    for r in elements.collect():
        keep, tags = O.evaluate(program, r["type"], r["tags"])
        if keep:
            want[r["id"]] = tags
    out = O.apply(program, elements)
    assert out.columns == elements.columns and result(out) == want
    assert result(O.apply_by_rows(program, elements)) == want


def test_documented_sample(elements):
    """Blocks within blocks, early decisions, and tags that earlier statements changed."""
    text = HEAD + 'TYPE node\n\tHAS "a"\n\t\tSET "b" "new"\n\t\tCOMMIT\n\tEQUALS "é" "1"\n\t\tDROP\nTYPE relation\n\tDROP\nSET "last" "yes"\n'
    got, before = result(apply_filters(elements, [text])), elements.collect()
    for r in before:
        if r["type"] == "node" and "a" in r["tags"]:
            assert got[r["id"]] == r["tags"] | {"b": "new"}
        elif r["type"] == "relation" or r["type"] == "node" and r["tags"].get("é") == "1":
            assert r["id"] not in got
        else:
            assert got[r["id"]] == r["tags"] | {"last": "yes"}


def test_chains(elements):
    first, second = HEAD + 'SET "x" "1"\nCOMMIT\nDROP', HEAD + 'EQUALS "x" "1"\n\tSET "y" "2"'
    got = result(apply_filters(elements, [first, "id < 60", second]))
    assert set(got) == set(range(60)) and all(t["x"] == "1" and t["y"] == "2" for t in got.values())


@pytest.mark.parametrize("n", [60, 400])
def test_long_programs(elements, n):
    text = HEAD + "".join(f'HAS "a"\n\tSET "k{i}" "{i}"\nEQUALS "k{i}" "{n}"\n\tDROP\n' for i in range(n // 4))
    got = result(apply_filters(elements, [text]))
    assert len(got) == 120 and all((f"k{n // 4 - 1}" in t) == ("a" in t) for t in got.values())


def test_selection_reaches_the_scan(spark, elements, tmp_path):
    """A program without modifiers is one condition, which scans get."""
    elements.write.parquet(f"{tmp_path}/e")
    pushed = lambda text: re.search(r"PushedFilters: \[([^\]]*\]?[^\]]*)\]", apply_filters(spark.read.parquet(f"{tmp_path}/e"), [text])._jdf.queryExecution().executedPlan().toString())[1]
    assert "Not(EqualTo(type,way))" in pushed(HEAD + "TYPE way\n\tDROP\n")
    assert "In(type, [node,way" in pushed(HEAD + 'TYPE node, way\n\tHAS "a"\n\t\tCOMMIT\nDROP\n')
    assert "GreaterThan(id,100)" in pushed("id > 100 && type == 'way'")


decisions = st.recursive(st.sampled_from([O.Commit(), O.Drop()]), lambda inner: st.builds(O.Block, selectors, st.lists(inner, min_size=1, max_size=3).map(tuple)), max_leaves=8)


@settings(max_examples=40, deadline=None)
@given(st.lists(decisions, min_size=1, max_size=5).map(tuple), st.sampled_from([0, 1, 256]))
def test_selections_as_one_condition(elements, body, limit):
    want = {r["id"] for r in elements.collect() if O.evaluate(O.Program("0.2.0", body), r["type"], r["tags"])[0]}
    kept = O._kept(O.reachable(body), limit)
    if kept is not None:
        assert {r["id"] for r in (elements.where(kept) if not isinstance(kept, bool) else elements if kept else elements.limit(0)).collect()} == want
    assert set(result(O.apply(O.Program("0.2.0", body), elements))) == want
