import pytest

from pagelattice.llm import residue

SCHEMA = "id long, title string, summary string, text_excerpt string, error string, domain string"


def fields(spark, rows, **options):
    df = spark.createDataFrame([(i, None, None, x, None, d) for i, d, x in rows], SCHEMA)
    return {r.tab_id for r in residue.residue_fields(df, **options).collect()}


@pytest.mark.parametrize("limit", [200_000, 0])
def test_a_template_one_site_never_fills_stays_residue(spark, limit):
    nouns = ["kiln", "fern", "mug", "tray", "lens", "bolt", "shelf", "clay"]
    rows = [(i, "hot.test", f"Welcome to {{{{site.name}}}} blog today with a {n}") for i, n in enumerate(nouns)]
    rows += [(20 + i, f"s{i}.test", f"Now set ${{HOME}} before you open the {n}") for i, n in enumerate(nouns)]
    assert fields(spark, rows, broadcast_contexts=limit) == set(range(8))


@pytest.mark.parametrize("limit", [200_000, 0])
def test_fillings_of_several_words_make_a_slot(spark, limit):
    rows = [(i, f"s{i}.test", f"A story by {{{{author}}}} was read to {n}") for i, n in enumerate(["all", "us", "them", "some"])]
    rows += [(20 + i, f"s{i}.test", f"A story by {a} was read to us") for i, a in enumerate(["Anna Maria Schmidt", "Jo van Berg", "Li Na", "Al B. Moe", "Ed Poe", "Ann Lee"])]
    assert fields(spark, rows, broadcast_contexts=limit) == {0, 1, 2, 3}


def test_repeated_error_pages_in_other_words(spark):
    nouns = ["kiln", "fern", "mug", "tray", "lens", "bolt", "shelf"]
    seen = [(i, None, None, f"Sidan /x{i}/y finns inte på s{i}.test. Gå tillbaka till startsidan.", None, f"s{i}.test") for i in range(7)]
    titled = [(10 + i, "404 Not Found", None, f"Tyvärr, här var det tomt. Försök igen om {i} minuter.", None, f"s{i}.test") for i in range(7)]
    banner = [(20 + i, None, None, f"Vi använder kakor på s{i}.test. {n.title()} makers meet in town number {n}.", None, f"s{i}.test") for i, n in enumerate(nouns)]
    plain = [(30 + i, None, "A null reading is not a zero reading.", None, None, f"s{i}.test") for i in range(7)]
    df = spark.createDataFrame(seen + titled + banner + plain, SCHEMA)
    got = {(r.tab_id, r.field) for r in residue.residue_fields(df).collect()}
    assert got == {(i, "text_excerpt") for i in [*range(7), *range(10, 17)]} | {(10 + i, "title") for i in range(7)}


@pytest.mark.parametrize("text", ["Dear [Your Name], we are glad", "Call <Company Name> for a quote", "Held on [Insert date here] at noon", "Hi {{user|upper}} and all", "First {{items[0]}} of many", "By ${user.name|html} today"])
def test_placeholders_of_several_words_filters_and_indexes(text):
    assert residue.suspicious_places(text)


@pytest.mark.parametrize("text", ["He said [sic] so [see the note below]", "a [link text](https://a.test) in text", "if a < b and c > d"])
def test_brackets_of_ordinary_text(text):
    assert not any(" " in token for token, _, _ in residue.suspicious_places(text))


def test_blank_slots(spark):
    names = ["Ann Lee", "Bo", "Cy Poe", "Di", "Ed Moe"]
    rows = [(i, f"s{i}.test", f"We thank our customer {n}, your order was sent on Monday") for i, n in enumerate(names)]
    rows += [(10, "s1.test", "We thank our customer , your order was sent on Monday"), (11, "s2.test", "It rained , so they say, all day"), (12, "s3.test", "Two  blanks alone mean nothing")]
    assert fields(spark, rows) == {10}
