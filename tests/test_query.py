import pytest

from gleanspark.plans.query import QueryParseError, compile_query, leaf_terms, lex, ranking_terms, to_prefix, wants_utility


@pytest.mark.parametrize(
    ("query", "prefix"),
    [
        ("apple", "appl"),
        ("-apple", "-appl"),
        ("apple & bird", "&(appl bird)"),
        ("apple bird", "&(appl bird)"),
        ("apple | bird & cat", "&(|(appl bird) cat)"),
        ("apple & (bird | cat)", "&(appl |(bird cat))"),
        ("-(apple & bird)", "-&(appl bird)"),
        ("apple & (bird | (cat & dog))", "&(appl |(bird &(cat dog)))"),
        ('"apple the bird" & cat', '&("appl bird" cat)'),
        ("foo-bar", "&(foo -bar)"),
        ("the & apple", "appl"),
        ("the", ""),
        ('"the of"', ""),
        ('"apple"', "appl"),
        ('"apple bird', '"appl bird"'),
        ("APPLE", "appl"),
        ('foo"bar"', "foo$bar"),
        ("a\\&b", "a&b"),
    ],
)
def test_compiles(query, prefix):
    assert to_prefix(compile_query(query)) == prefix


@pytest.mark.parametrize("query", ["", "()", "-()", "a &", "& a", "(a & b", "a & b)", "a & (b | -)", "a & (b | (c & ))"])
def test_malformed(query):
    with pytest.raises(QueryParseError):
        compile_query(query)


def test_synonyms_and_terms():
    node = compile_query("car & -tree bus", {"car": ["automobile", "motor car", "cars"]})
    assert to_prefix(node) == '&(&(~(car automobil "motor car") -tree) bus)'
    assert ranking_terms(node) == (["car", "bus"], ["automobil", "motor", "car"])
    assert leaf_terms(node) == ["car", "automobil", "motor", "tree", "bus"]


def test_url_encoded():
    assert to_prefix(compile_query("Red%20apple+%7C+cat", url_encoded=True)) == "|(&(red appl) cat)"


def test_lex_and_intent():
    assert lex('a(b"c d"') == [("word", "a"), ("op", "("), ("word", "b$c d")]
    assert wants_utility(["site", "legal"]) and not wants_utility(["legal", "site"])
