"""Languages in comments: clauses, code, mixtures, damage, and held-out sentences for each language state."""

import numpy as np
import pytest

from loregraph.llm import language

HELD_OUT = {
    "en": ["Make sure that nobody else is using the socket at this point", "the parser gives up too early here"],
    "de": ["Darum kümmern wir uns, wenn die neue Fassung fertig ist", "das gilt auch für leere Listen"],
    "fr": ["On ne peut pas savoir combien de lignes il reste", "cette valeur vient du fichier de configuration"],
    "es": ["No sabemos cuántas filas quedan todavía", "este valor viene del archivo de configuración"],
    "pt": ["Não sabemos quantas linhas ainda faltam", "este valor vem do arquivo de configuração"],
    "pl": ["Nie wiadomo, ile wierszy jeszcze zostało", "ta wartość pochodzi z pliku konfiguracji"],
    "ru": ["Неизвестно, сколько строк ещё осталось", "это значение берётся из файла настроек"],
    "zh": ["不知道还剩多少行", "这个值来自配置文件"],
    "ja": ["あと何行残っているか分からない", "この値は設定ファイルから来る"],
}
CODE = ["", " ", "inventory", "v1.2.3", "ABC-12", "0x3fa9", "======", "@ts-ignore", "eslint-disable-next-line no-console", "prettier-ignore", "#region lamp", "https://a.example/lamp/12", "const x = f(a, 3);", "if (a && !b) return;",
        "return lamp ?? door;", "await go(ctx.lamp, { door: true })", "console.log(lamp.door)", "import { a } from './b';", "<Lamp door={3} />", "lamp[3].door++"]


@pytest.mark.parametrize("lang", HELD_OUT)
def test_held_out(lang):
    assert [list(d) for d in language.detect(HELD_OUT[lang])] == [[lang]] * 2


@pytest.mark.parametrize("text", CODE)
def test_code(text):
    assert language.detect([text]) == [{}]


def test_mixtures_damage_and_literals():
    cases = {
        "This must stay here for now. das gilt auch für leere Listen": {"en", "de"},
        "on ne peut pas savoir / we have to wait for the answer": {"fr", "en"},
        'throw new Error("the lamp must be closed first");': {"en"},
        "notify(`das gilt auch für leere Listen`);": {"de"},
        "pamiec musi byc wyczyszczona, bo lista jest pusta": {"pl"},
        "es mÃ¡s lento de lo que parece": {"es"},
        "THIS IS MUCH SLOWER THAN IT LOOKS": {"en"},
        "keep it since `loadLamp` changes its argument -> #12": {"en"},
        "这个值来自配置文件，因为 loadLamp() 可能为空!": {"zh"},
        "notify(`不知道还剩多少行`);": {"zh"},
    }
    for (text, want), got in zip(cases.items(), language.detect(list(cases)), strict=True):
        assert set(got) == want, (text, got)


def test_whole_source_files():
    src = '// We have to wait here until it is ready\nexport function the(of: a, and: b) {\n  return "das gilt auch für leere Listen";\n}\n' + "const a = b(c);\n" * 600 + "/* cette valeur vient du fichier */\n"
    (got,) = language.detect([src], source=True)
    assert set(got) == {"en", "de", "fr"}


def test_viterbi_is_the_best_path():
    m = language.model()
    text = "ja gut das"
    (path,) = language.paths([text])
    gap = m.codes[" "]
    emit = m.emissions(np.concatenate([m.encode(language.plain(text)), np.full(language.ORDER, gap)]))[: len(text)]
    moves = [i for i in range(1, len(text)) if not (text[i].isalpha() and text[i - 1].isalpha())]

    def score(p):
        return sum(emit[i, s] for i, s in enumerate(p)) + language.CHANGE * sum(p[i] != p[i - 1] for i in moves)

    rng = np.random.default_rng(1)
    for _ in range(500):
        other, s = [], 0
        for i in range(len(text)):
            if i == 0 or i in moves and rng.random() < 0.3:
                s = int(rng.integers(len(language.STATES)))
            other.append(s)
        assert score(list(path)) >= score(other) - 1e-3


def test_table(spark):
    rows = [(1, "we have to wait for it", "x"), (1, "we have to wait for it", "x"), (2, None, None), (3, "", ""), (None, "das gilt auch für leere Listen", "")]
    df = spark.createDataFrame(rows, "id long, text string, lang string")
    assert sorted((r.id or 0, r.lang) for r in language.spoken(df, ["id"]).collect()) == [(0, "de"), (1, "en"), (1, "en")]
    assert language.spoken(df.limit(0), ["id"]).count() == 0


def test_rows_without_a_clause_and_long_keys(spark):
    none = [(1, "inventory item"), (2, "eslint-disable-next-line no-console")]  # the pre-filter lets them through
    assert language.spoken(spark.createDataFrame(none, "id long, text string").coalesce(1), ["id"]).collect() == []
    last = spark.createDataFrame([(i, "we have to wait for it") for i in range(4000)] + none, "id long, text string").coalesce(1)  # the part of a batch that is left over has none
    assert language.spoken(last, ["id"]).distinct().count() == 4000
    keys = [2**53 + 1, 2**63 - 1, None]
    rows = spark.createDataFrame([(k, "we have to wait for it") for k in keys], "id long, text string").coalesce(1)
    assert [r.id for r in language.spoken(rows, ["id"]).collect()] == keys
