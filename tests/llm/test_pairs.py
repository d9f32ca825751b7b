"""Code-description pairs: signatures, bodies, attached comments and what counts as informative."""

import pytest

from loregraph.llm import pairs

TS = """// unrelated

/** Loads a lamp. Falls back to the cellar when it is dark. */
export async function loadLamp(id: string, o?: { a: number }): Promise<Lamp> {
  const s = "}{";
  if (x) { return 1; } // }
}

class A {
  /**
   * Keeps
   * two lines.
   */
  @cached
  private fetchAll(n: number): void {
    go();
  }
}
// far away



const pick = (a: number) => {
  return a;
};
"""
PY = '''# Adds lamps
# in order.
def add(a, b=(1, 2)):
    """Docstring wins."""
    if a:
        return b

    return a

async def later():
    pass
'''
RUBY = """# Opens the door once.
def open_door(key)
  if key
    items.each do |i|
      i.go
    end
  end
end

def shut
end
"""


def test_braces():
    got = {f.name: f for f in pairs.functions_of(TS)}
    assert set(got) == {"loadLamp", "fetchAll", "pick"}
    assert got["loadLamp"].body.endswith("// }\n}") and got["loadLamp"].description.startswith("Loads a lamp.")
    assert got["fetchAll"].description == "Keeps\ntwo lines." and got["pick"].description == ""
    assert got["loadLamp"].signature.startswith("export async function loadLamp(")


def test_indentation_and_end_keywords():
    got = {f.name: f for f in pairs.functions_of(PY)}
    assert got["add"].description == "Docstring wins." and got["add"].body.endswith("return a") and got["later"].body.endswith("pass")
    got = {f.name: f for f in pairs.functions_of(RUBY)}
    assert got["open_door"].body.count("end") == 3 and got["open_door"].description == "Opens the door once." and got["shut"].body == "def shut\nend"


def test_cut_short_and_empty():
    assert pairs.functions_of("") == [] and pairs.functions_of("x = 1") == []
    assert pairs.functions_of("function f() {\n  if (a) {")[0].body == "function f() {\n  if (a) {"


@pytest.mark.parametrize(
    "text",
    ["", None, "   ", "*", "-----", "/** */", "Load lamp.", "Loads the lamp.", "This function loads the lamp", "Method to load lamp.", "loadLamp()", "Load lamp helper.", "@inheritdoc", "{@inheritDoc}", "@param x the thing to use here",
     "See above.", "see docs", "Same as above", "TODO: explain the edge cases in detail", "tbd", "n/a", "No description provided.", "Documentation pending", "Auto-generated documentation for loadLamp.", "Lorem ipsum", "Insert description here.", "???", "FIXME add docs"],
)
def test_trivial(text):
    assert not pairs.informative(text, "loadLamp")


@pytest.mark.parametrize("text", ["Null when the cache is cold.", "Load lamp.\n * Throws when two users differ.", "<p>Groups every lamp by <code>room</code> and drops small groups.</p>", "Renvoie la valeur par défaut si lamp est vide.", "Gibt null zurück, wenn kein Treffer da ist."])
def test_informative(text):
    assert pairs.informative(text, "loadLamp")


def test_tables(spark):
    code = "function loadLamp(a: string): void {\n}"
    f = [(1, "r", "p", "loadLamp", code, "2024-01-01", "x"), (1, "r", "p", "loadLamp", code, "2024-02-01", "x"), (2, "r", "p", "other", "", "2024-01-01", "x"), (3, "r", "p", "gone", code, None, "x"), (4, "r", "p", "loadLamp", None, "2024-01-01", "x")]
    functions = spark.createDataFrame(f, "func_id long, repo string, path string, func_name string, code_snippet string, extracted_at string, jsdoc string")
    docs = "map<string, struct<description: string, return_doc: string>>"
    files = spark.createDataFrame([("r", "p", "2024-01-01", {"loadLamp": ("Throws when */ the cellar is dark.", None), "other": ("Long enough to count here.", None), "gone": (None, None)}, 7), ("r", "p", "2024-01-02", None, 7)], f"repo string, path string, extracted_at string, jsdoc {docs}, func_id int")
    got = pairs.newest(pairs.paired(functions, files, "signature", "description"), "kept", "description", "signature").collect()
    assert [(r.func_id, r.kept, r.description, r.signature) for r in got] == [(1, True, "Throws when */ the cellar is dark.", "function loadLamp(a: string): void")]
    assert pairs.paired(functions.limit(0), files).count() == 0 and pairs.paired(functions, files.limit(0)).count() == 0


def test_pairs_come_through_the_parser(spark, monkeypatch):
    """Code without a signature gives no pair; the name is the signature's, and a comment beside it comes out with it."""
    code = "/** Keeps the door shut. */\nexport const openDoor = async (key: string) => {\n  return 1;\n};"
    f = [(1, "r", "p", "openDoor", code, "2024-01-01"), (2, "r", "p", "openDoor", "return key + 1;", "2024-01-01"), (3, "r", "p", None, code, "2024-01-01")]
    functions = spark.createDataFrame(f, "func_id long, repo string, path string, func_name string, code_snippet string, extracted_at string")
    files = spark.createDataFrame([("r", "p", "2024-01-01", {"openDoor": ("Null when the cellar is cold.",)})], "repo string, path string, extracted_at string, jsdoc map<string, struct<description: string>>")
    rows = pairs.paired(functions, files, "comment", "signature").collect()
    assert sorted((r.func_id, r.comment) for r in rows) == [(1, "Keeps the door shut."), (3, "Keeps the door shut.")]


def test_brackets_and_long_texts():
    import time

    assert pairs.functions_of("function f(a = g(h(1, (2))), b) {\n}")[0].signature == "function f(a = g(h(1, (2))), b)"
    assert pairs.functions_of("const f = x => x + 1;\nfunction g() {\n}")[0].body == "const f = x => x + 1;"
    began = time.time()
    assert pairs.functions_of("call(a, [\n" * 20000) == []
    assert len(pairs.functions_of("function f(a) {\n  g('{');\n}\n" * 5000)) == 5000
    assert time.time() - began < 20
