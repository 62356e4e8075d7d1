import pytest

from cartweave.errors import FilterSyntaxError
from cartweave.plans import cel
from cartweave.schema import ELEMENT

ROWS = [
    ("node", 1, 2, 7, 5, "ann", "2020-02-03T04:05:06Z", True, {"name": "Zoo", "n": "12", "e": ""}, 1.0, 2.0, None, None),
    ("way", -8, None, None, None, None, None, None, {}, None, None, [1, 2], None),
    ("relation", 2**62, 1, 3, 5, "bob é", "2021-01-01T00:00:00Z", False, {"name": "zoo"}, None, None, None, []),
]
ANN, WAY, BOB = (r[1] for r in ROWS)


@pytest.fixture(scope="module")
def elements(spark):
    return spark.createDataFrame(ROWS, ELEMENT).cache()


#: Expression, and the ids it keeps. An error drops the row.
CASES = [
    ("true", {ANN, WAY, BOB}), ("false", set()), ("1 == 1.0", {ANN, WAY, BOB}), ("1u == 1 && 2u > 1", {ANN, WAY, BOB}), ("1 == '1'", set()), ("1 != '1'", {ANN, WAY, BOB}),
    ("type == 'node'", {ANN}), ("id < 0", {WAY}), ("tags.name == 'Zoo'", {ANN}), ("tags['name'] == \"zoo\"", {BOB}), ("tags.e == ''", {ANN}), ("tags.missing != 'x'", set()), ("!(tags.missing == 'x')", set()),
    ("has(tags.name)", {ANN, BOB}), ("!has(tags.name)", {WAY}), ("'name' in tags", {ANN, BOB}), ("type in ['way', 'node']", {ANN, WAY}), ("id in [1, 2]", {ANN}), ("1 in ['a', 1]", {ANN, WAY, BOB}), ("user in ['ann', null]", {ANN, WAY}),
    ("user == null", {WAY}), ("user != null", {ANN, BOB}), ("user == 'ann'", {ANN}), ("user != 'ann'", {WAY, BOB}), ("null == null", {ANN, WAY, BOB}), ("changeset > 3", {ANN}), ("!(changeset > 3)", {BOB}), ("visible", {ANN}), ("!visible", {BOB}), ("visible == true", {ANN}), ("visible != true", {WAY, BOB}),
    ("changeset > 3 || true", {ANN, WAY, BOB}), ("true || changeset > 3", {ANN, WAY, BOB}), ("changeset > 3 && false", set()), ("tags.missing == 'x' || id == 1", {ANN}), ("changeset > 100 || type == 'way'", {WAY}),
    ("visible == null ? true : visible", {ANN, WAY}), ("changeset > 3 ? true : true", {ANN, BOB}), ("true ? id == 1 : id / 0 == 1", {ANN}),
    ("7 / 2 == 3 && -7 / 2 == -3 && 7 % -2 == 1 && -7 % 2 == -1", {ANN, WAY, BOB}), ("7.0 / 2.0 == 3.5", {ANN, WAY, BOB}), ("1 / 0 == 1", set()), ("1 % 0 == 1 || true", {ANN, WAY, BOB}), ("1.0 / 0.0 > 1e300", {ANN, WAY, BOB}), ("1 + 1.0 == 2.0", set()), ("id + id > 0", {ANN}), ("id * 2 == 2", {ANN}), ("-id == 8", {WAY}),
    ("9223372036854775807 + 1 > 0", set()), ("-9223372036854775808 < 0", {ANN, WAY, BOB}), ("0x1F == 31", {ANN, WAY, BOB}), ("1u - 2u == 0u || true", {ANN, WAY, BOB}), ("5u / 2u == 2u && 5u % 2u == 1u", {ANN, WAY, BOB}),
    ("'a' + 'b' == 'ab'", {ANN, WAY, BOB}), ("size(tags) == 3 && size(tags.name) == 3 && size([1, 2]) == 2", {ANN}), ("tags.size() == 0", {WAY}), ("size(user) == 5", {BOB}), ("[1, 2] + [3] == [1, 2, 3]", {ANN, WAY, BOB}), ("[1, 2, 3][1] == 2", {ANN, WAY, BOB}), ("[1][5] == 1 || true", {ANN, WAY, BOB}),
    ("tags.name.startsWith('Z') || tags.name.endsWith('x')", {ANN}), ("tags.name.contains('oo')", {ANN, BOB}), ("tags.name.matches('^[A-Z]o+$')", {ANN}), ("matches(tags.name, 'o{2}')", {ANN, BOB}), ("'abc' < 'abd' && 'B' < 'a'", {ANN, WAY, BOB}),
    ("int(tags.n) == 12", {ANN}), ("int('x') == 1 || true", {ANN, WAY, BOB}), ("double('1e3') == 1000.0", {ANN, WAY, BOB}), ("string(id) == '1'", {ANN}), ("int(2.9) == 2 && int(-2.9) == -2 && uint(3) == 3u && double(2) == 2.0", {ANN, WAY, BOB}), ("bool('true') && !bool('F')", {ANN, WAY, BOB}), ("string(true) == 'true' && string(1.5) == '1.5' && string(2.0) == '2'", {ANN, WAY, BOB}),
    ("type(user) == string", {ANN, BOB}), ("type(user) == null_type", {WAY}), ("type(1) == int && type(1.0) == double && type('') == string && type([]) == list && type(tags) == map && type(true) == bool", {ANN, WAY, BOB}), ("dyn(id) == 1", {ANN}),
    ("timestamp(timestamp) < timestamp('2020-12-31T00:00:00Z')", {ANN}), ("timestamp(timestamp).getFullYear() == 2021 && timestamp(timestamp).getMonth() == 0 && timestamp(timestamp).getDayOfMonth() == 0 && timestamp(timestamp).getDate() == 1", {BOB}), ("timestamp(timestamp).getHours() == 4 && timestamp(timestamp).getMinutes() == 5 && timestamp(timestamp).getSeconds() == 6 && timestamp(timestamp).getDayOfWeek() == 1 && timestamp(timestamp).getDayOfYear() == 33", {ANN}),
    ("timestamp('2020-01-01T00:00:00Z') + duration('1h30m') == timestamp('2020-01-01T01:30:00Z')", {ANN, WAY, BOB}), ("timestamp('2020-01-02T00:00:00Z') - timestamp('2020-01-01T00:00:00Z') == duration('24h')", {ANN, WAY, BOB}), ("duration('90s').getMinutes() == 1 && duration('1.5s') > duration('1s')", {ANN, WAY, BOB}), ("timestamp('nonsense') > timestamp('2020-01-01T00:00:00Z')", set()),
    ("tags.exists(k, k == 'name' && tags[k] == 'zoo')", {BOB}), ("tags.all(k, size(k) <= 4)", {ANN, WAY, BOB}), ("tags.exists_one(k, k.startsWith('n'))", {BOB}), ("[1, 2, 3].filter(x, x > 1) == [2, 3] && [1, 2].map(x, x * 2) == [2, 4]", {ANN, WAY, BOB}), ("[1, 2].all(x, x > 0) && ![1, 2].exists(x, x > 2)", {ANN, WAY, BOB}), ("['a', 'b'].exists(x, x in tags)", set()),
    ("{'a': 1}['a'] == 1 && {'a': 1}.a == 1 && {'a': 1} == {'a': 1}", {ANN, WAY, BOB}), ("r'\\d' == '\\\\d' && '''a'b''' == \"a'b\" && '\\u00e9' == 'é' && '\\x41\\101' == 'AA'", {ANN, WAY, BOB}), ("// comment\nid == 1 // and more", {ANN}), ("(((id)) == (1))", {ANN}), ("true ? (false ? true : id == 1) : false", {ANN}), ("false ? true : true ? id == 1 : false", {ANN}), ("!!true && !(!true)", {ANN, WAY, BOB}), ("1 < 2 == true", {ANN, WAY, BOB}), ("tags['na' + 'me'] == 'Zoo'", {ANN}),
]


@pytest.mark.parametrize(("text", "want"), CASES, ids=[c[0][:50] for c in CASES])
def test_expressions(elements, text, want):
    assert {r["id"] for r in cel.apply(text, elements).collect()} == want


@pytest.mark.parametrize("text", ["", "id", "'x'", "tags", "user", "unknown == 1", "version == 1", "lat > 1.0", "id ==", "id == 1 )", "(id == 1", "foo(id)", "id.foo() == 1", "'unclosed", "1 = 1", "has(tags)", "[1, 2", "if == 1", "99999999999999999999 == 1", "tags.name.matches('[')", "'\\q' == ''", "id == 1 id", "true ? false ? true : id == 1 : false", "true ? 1 : 2", "@"])
def test_mistakes(spark, text):
    with pytest.raises(FilterSyntaxError):
        cel.compile_expression(text)


def test_a_literal_pattern_is_checked_first(spark):
    with pytest.raises(FilterSyntaxError, match="pattern"):
        cel.compile_expression("tags.name.matches('(')")
