"""Calendar rows, model answers and the nine guard-rails on small cases."""

import os

import pytest
from pyspark.sql import functions as F

from tessera.functions import answers
from tessera.plans import calendar, editorial, rules


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"c {kind}").select(f(F.col("c")).alias("r")).first()["r"]


def test_calendar_rows(spark):
    schema = "n int, year int, day_lines array<string>, feast_lines array<string>, marian_lines array<string>, liturgy_lines array<string>"
    good = ["Roxo/Branco", "Glória, sem Credo", "Prefácio comum", "Rm 1, 1 • Mt 2, 3"]
    rows = [
        (1, 2026, ["1 de Julho", "Quarta"], ["Preciosíssimo Sangue", "(Próprio do Brasil)", "1ª classe"], ["–", "Jejum", "S. João"], good),
        (2, 2025, ["5 de Outubro", "Domigo"], ["XVII Domingo"], None, ["Verde"]),
        (3, 2026, ["31 de Fevereiro", "Sábado"], ["x"], [], []),
        (4, 2026, ["2 de Março", "Terça-feira"], [], [], []),
        (5, 2026, ["Dia"], ["Festa"], [], []),
        (6, 2026, None, None, None, None),
    ]
    days, rejects = calendar.read_rows(spark.createDataFrame(rows, schema))
    got = {r["n"]: r for r in days.collect()}
    a = got[1]
    assert (a["date"], a["weekday"], a["feast"], a["commemoration"], a["classis"]) == ("2026-07-01", "Quarta", "Preciosíssimo Sangue", "(Próprio do Brasil)", "1ª classe")
    assert (a["marian_saint"], a["note"], a["color"], a["gloria"], a["credo"], a["preface"], a["epistle"], a["gospel"]) == ("S. João", "Jejum", "Roxo/Branco", True, False, "Prefácio comum", "Rm 1, 1", "Mt 2, 3") and a["warnings"] == []
    assert got[2]["weekday"] == "Domingo" and got[2]["warnings"] == ["weekday unreadable", "no readings"] and got[2]["marian_saint"] is None
    assert {r["n"]: r["reason"] for r in rejects.collect()} == {3: "no date", 4: "no feast", 6: "no date"}


@pytest.mark.parametrize(("line", "want"), [("Róseo ou Roxo", True), ("Roxo/Branco", True), ("Roxo claro", False), ("", False)])
def test_colours(spark, line, want):
    assert one(spark, line, calendar.is_colour) is want


def test_draft(spark):
    blocks = "<think>hm</think>```\n**TÍTULO: Um título**\nDEK: Apoio\nCATEGORIA: Santos\nTAGS: Fé, fé; Papa\nCORPO:\nPrimeiro.\n\nSegundo.\n```"
    got = one(spark, blocks, answers.read_draft)
    assert (got["title"], got["dek"], got["body"], got["category"], got["tags"]) == ("Um título", "Apoio", "Primeiro.\n\nSegundo.", "santos", ["fé", "papa"])
    got = one(spark, 'Aqui está: {"titulo": "T", "dek": "D", "corpo_md": "B"} fim', answers.read_draft)
    assert (got["title"], got["body"], got["category"], got["tags"]) == ("T", "B", "", [])
    assert one(spark, "nada", answers.read_draft) is None and one(spark, None, answers.read_draft) is None and one(spark, "<think>aberto", answers.without_reasoning) == ""


def test_verdict(spark):
    assert tuple(one(spark, '{ "VEREDITO": "CONSISTENTE", "DIVERGENCIAS": [] }', answers.read_verdict)) == (True, [])
    told = one(spark, 'VEREDITO: DIVERGENTE\nDIVERGENCIAS:\n- a versão não menciona a data exata\n- "Papa Francisco" onde era "Pope Leo XIV"', answers.read_verdict)
    assert not told["consistent"] and told["divergences"] == ['"Papa Francisco" onde era "Pope Leo XIV"']
    assert tuple(one(spark, "VEREDITO: DIVERGENTE\nDIVERGENCIAS:\n- o texto não menciona a data", answers.read_verdict)) == (True, [])
    assert one(spark, "sem resposta", answers.read_verdict) is None and one(spark, None, answers.read_verdict) is None


def test_numbers_with_numerals(spark):
    assert sorted(one(spark, "1. item\n1,234 e 1 234 [x](http://a/9) 007", editorial.content_numbers)) == ["1234", "7"]
    assert {"12", "21", "3"} <= set(one(spark, "Twelve bishops, twenty-one nuns and 3 abbots", editorial.allowed_numbers))


def test_nine_rules(spark):
    schema = "body string, title string, dek string, original string, source_length int, source string, source_name string, source_url string, verdict struct<consistent:boolean,divergences:array<string>>, tags array<string>"
    body = "\n\n".join(["A celebração reuniu 12 fiéis em São João, não além da oração à tarde de domingo. " * 4] * 3)
    fine = (body, "A celebração de domingo", "Uma oração à tarde reuniu os fiéis da região", "twelve people " * 200, 2800, "ewtn", "EWTN", "https://www.ewtnnews.com/x", (True, []), ["um", "dois"])
    rows = [
        fine,
        (body + " I'm sorry", *fine[1:]),
        (body + " primeira leitura", *fine[1:]),
        (body + " Holy See", *fine[1:]),
        (*fine[:7], "https://elsewhere.org/x", *fine[8:]),
        (*fine[:8], None, fine[9]),
        (*fine[:8], (False, ["a", "b"]), fine[9]),
        (body + " 77", *fine[1:]),
        (None,) * 10,
    ]
    made = rules.judge(editorial.facts(spark.createDataFrame([(*r,) for r in rows], schema)), editorial.NINE_RULES).select("failed_rules", "passed", "errors").collect()
    assert [r["failed_rules"] for r in made[:8]] == [[], ["recusa_do_modelo"], ["rito_1962"], ["glossario"], ["atribuicao"], ["verificacao_factual"], ["verificacao_factual"], ["numeros"]]
    assert made[0]["passed"] and len(made[6]["errors"]) == 2 and not made[8]["passed"]
    allowed = rules.judge(editorial.facts(spark.createDataFrame([(body + " primeira leitura", *fine[1:3], fine[3] + "the first reading", *fine[4:])], schema)), editorial.NINE_RULES).first()
    assert allowed["passed"]


def test_full_word_lists(spark):
    from tessera.functions.text import english_share, stop_counts
    from tessera.plans import classify

    titles = {"Pontiff opens consistory": "vaticano", "Baptism and missal": "liturgia", "Help for the homeless": "caridade", "A fresco": "patrimonio", "Commentary": "opiniao", "Nothing": None}
    rows = spark.createDataFrame([(t,) for t in titles], "t string").select("t", classify.lexicon_category(F.col("t")).alias("c")).collect()
    assert {r["t"]: r["c"] for r in rows} == titles
    c = stop_counts(F.col("t"))
    assert tuple(spark.createDataFrame([("She said he will, you should; isso já havia",)], "t string").select(c["en"], c["pt"], english_share(c)).first()) == (6, 3, 6 / 9)


def test_length_and_ratio(spark):
    """An empty original falls back to the source's length; tags and trimmed titles count; null columns fail and never stop the job."""
    schema = "body string, title string, dek string, original string, source_length int, tags array<string>"
    body = "\n\n".join(["palavra " * 40] * 3)
    rows = [(f"  {body}\n", "Um título que basta", "d" * 60, "", 2400, ["a", "b"]), (body, " Curto              ", "d" * 60, "o" * 2400, 9999, ["a", "b"]), (body, "Um título que basta", "d" * 60, "o" * 2400, 9999, None), (body, "Um título que basta", "d" * 60, "o", 0, ["a"] * 7), (None,) * 6]
    two = (("comprimento", rules.length_rule), ("proporcao", rules.ratio_rule))
    made = rules.judge(spark.createDataFrame(rows, schema), two).select("errors", rules.too_long_alone(F.col("failed_rules")).alias("again")).collect()
    assert [r["errors"] for r in made] == [[], ["comprimento: title"], ["comprimento: tags"], ["comprimento: tags", "proporcao: unknown source length"], ["comprimento: empty", "proporcao: unknown source length"]]
    assert [r["again"] for r in made] == [False, True, True, True, True]


def test_rules_that_throw(spark):
    """A rule that fails on one row fails this row with its reason and leaves the others; one that fails as a whole fails all; the rest goes on."""
    rows = spark.createDataFrame([(k, f"t{k}", "d", "b", "o") for k in range(6)] + [(None, "t", "d", "b", "o")], "n long, title string, dek string, body string, original string")
    ratio = rules.RowRule("razao", ("n",), lambda ns: [["pouco"] if 12 / (n - 3) < 0 else [] for n in ns])
    broken = rules.RowRule("quebrada", ("title", "n"), lambda ts, ns: [])
    fine = rules.RowRule("boa", ("title",), lambda ts: [["cinco"] * (t == "t5") for t in ts])
    plain = (("coluna", lambda: F.array(F.when(F.col("n") == 1, "um"))),)
    got = {r["n"]: (r["failed_rules"], r["errors"], r["passed"]) for r in rules.judge(rows, plain, (ratio, fine)).collect()}
    assert got[0] == (["razao"], ["razao: pouco"], False) and got[1] == (["coluna", "razao"], ["coluna: um", "razao: pouco"], False) and got[4] == ([], [], True) and got[5] == (["boa"], ["boa: cinco"], False)
    assert got[3][1] == ["razao: a própria checagem falhou (division by zero) — reprovado por precaução."] and "NoneType" in got[None][1][0]
    every = rules.judge(rows, (), (broken, fine)).select("errors").collect()
    assert all(r["errors"][0].startswith("quebrada: a própria checagem falhou") for r in every)
    long = rules.judge(rows, (), (rules.RowRule("longa", ("n",), lambda ns: [["x" * 900] * 22 for _ in ns]),)).first()["errors"]
    assert len(long) == 21 and len(long[0]) == 501 and long[20] == "(+2 erro(s) omitido(s))"


def test_verdict_in_json(spark):
    assert tuple(one(spark, '{ "VEREDITO": "CONSISTENTE", "DIVERGENCIAS": [] }', answers.read_verdict)) == (True, [])
    assert tuple(one(spark, '{"veredito": "divergente", "divergencia": ["Roma, não Milão"]}', answers.read_verdict)) == (False, ["Roma, não Milão"])
    assert one(spark, '{"outro": 1}', answers.read_verdict) is None


@pytest.mark.parametrize(
    ("claim", "noise"),
    [
        ("“a freira Leticia Ugboaja” — no original dizia “Sister Leticia Ugboaja”", True), ("“Guerra da Independência” — o original dizia “the Civil War”", False), ("“Papa Francisco” — no original era “Pope Leo XIV”", False), (None, False), ("", False),
        ("“nos dias 4 e 5 de agosto” — no original era “from Aug. 4–5”", True), ("“1.234 fiéis” — o original diz “1,234 faithful”", True), ("“não veio” — o original diz “came”", False), ("“um” “dois” “três”", False),
    ],
)
def test_structural_noise(spark, claim, noise):
    from tessera.functions import divergences

    assert divergences.with_noise(spark.createDataFrame([(claim,)], "claim string"), "claim").first()["noise"] is noise


def test_states(spark):
    from tessera.plans import adapt

    schema = "k int, attempt int, ready boolean, answer_error string, check_error string, verdict_read boolean, failed_rules array<string>, tokens_in int, tokens_out int"
    rows = [(1, 1, True, None, None, True, ["proporcao"], 5, None), (1, 2, True, None, None, True, [], 6, None), (2, 1, None, None, None, None, None, None, None), (3, 1, True, "desativado", None, None, None, None, 1), (4, 1, True, "recusa", None, None, None, None, 1), (5, 1, True, None, None, None, [], 1, 1)]
    got = {r["k"]: tuple(r)[1:] for r in adapt.final_states(spark.createDataFrame(rows, schema), "k").collect()}
    assert got == {1: ("published", "published", 2, 11, None), 2: ("failed_validation", "preflight", 1, None, None), 3: ("draft", "answer_error", 1, None, 1), 4: ("failed_validation", "answer_error", 1, None, 1), 5: ("draft", "deferred", 1, 1, 1)}
    assert adapt.token_totals(adapt.final_states(spark.createDataFrame([], schema), "k")).first()["tokens_in"] == 0


def test_calendar_pages(spark, tmp_path):
    page = "<h2>Calendário de 2026</h2><table><tr><th>Dia</th><th>x</th><th>y</th><th>z</th></tr><tr><td>1 de Julho<br>Domigo</td><td><p>Festa</p></td><td>-</td><td>Róseo ou Roxo<br>A • B</td></tr><tr><td>1 de Julho</td><td>Outra</td><td></td><td></td></tr><tr><td>31 de Fevereiro</td><td>F</td><td></td><td></td></tr><tr><td>só</td></tr></table>"
    pages = spark.createDataFrame([(1, page, "https://c/"), (2, None, None), (3, "", "x")], "page_id int, html string, url string")
    days, rejects = calendar.read_rows(calendar.page_rows(pages, expected=2026))
    got = calendar.last_wins(days).collect()
    assert [(r["date"], r["feast"], r["repeated"], r["year_warning"]) for r in got] == [("2026-07-01", "Outra", True, None)] and [r["reason"] for r in rejects.collect()] == ["no date"]
    assert (days.count(), rejects.count()) == (2, 1) and calendar.verdict({"days": 2, "rejects": 1}) == {"days": 2, "rejects": 1, "ratio": 1 / 3, "abort": True} and calendar.verdict({"days": 0, "rejects": 0})["abort"]
    rows = calendar.judged_rows(calendar.page_rows(pages, expected=2026))
    assert calendar.publish(rows, str(tmp_path / "days"))["abort"] and not os.path.exists(tmp_path / "days")
    assert not calendar.publish(rows, str(tmp_path / "days"), most=0.5)["abort"] and spark.read.parquet(str(tmp_path / "days")).select("date").distinct().count() == spark.read.parquet(str(tmp_path / "days")).count() > 0


def test_text_is_unaccented_once_a_row(spark):
    """However many terms the rite's rule looks for, also behind array_compact."""
    schema = "title string, dek string, body string, original string"
    facts = editorial.facts(spark.createDataFrame([("a", "b", "c", "d")], schema))
    plan = rules.judge(facts, (("rito_1962", editorial.rite_rule),))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("translate(") == 1
