"""Work done for each word of a text is done once, or only where it can matter."""

from datetime import date

from factloom.functions import credentials, guards, lexical, vector


class Never:
    def match(self, *_):
        raise AssertionError("a rule tried on a word that cannot fit")


def test_rules_meet_only_words_that_can_fit(spark, monkeypatch):
    assert credentials.scan("id AKIA" + "Z" * 16).rule == "aws_access_key_id"
    assert credentials.scan("bearer " + "0a" * 10, 20).rule == "hex_credential"
    plan = spark.range(1).select(credentials.finding_sql(vector.F.col("id").cast("string")).alias("rule"))._jdf.queryExecution().analyzed().toString()
    assert plan.lower().count("contains(") == len(credentials.PREFIXES)
    monkeypatch.setattr(credentials, "_PREFIXED", [(Never(), "", "")])
    assert credentials.scan("plain words of a text, none of them long " * 20) is None


def test_words_are_looked_up_once():
    said = "Ordered 2023-01-05, sent March 12, 2024; again 5 Jan 2023, due 2024-02-31."
    assert guards.dates_in(said) == guards.dates_in(said) == [date(2023, 1, 5), date(2024, 3, 12)]
    assert list(vector.embed_text("Été words words", 8)) == list(vector.embed_text(" t words WORDS", 8))
    assert lexical.lexeme("running") == lexical.lexeme("running") == "run"
    assert all(f.cache_info().hits for f in (guards._month, guards._number, guards._iso, vector._place, lexical.lexeme))
