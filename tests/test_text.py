import pytest
from pyspark.sql import functions as F

from quizloom.functions import classify, text
from quizloom.operators import split


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "v string").select(column(F.col("v"))).first()[0]


@pytest.mark.parametrize("f,value,want", [
    (text.slug, "  5.1 Energy — 能量 (Demo)! ", "5-1-energy------demo"),
    (text.from_scripts, "H₂SO₄²⁻", "H2SO42-"),
    (text.to_subscripts, "x2", "x₂"),
    (text.unglued, "and23 wasC out", "and 23 was C out"),
    (text.arrows, "8HI + H2SO4 = H2S", "8HI + H2SO4 → H2S"),
    (text.arrows, "a  b", "a → b"),
    (text.without_footers, "1 Stem\n© UCLES 2021\nmore\n\n\n\nend\n\n 12 \n", "1 Stem\nmore\n\nend"),
    (text.without_footers, "a\nPermission to reproduce items\nb", "a"),
    (text.escaped, "<a & 'b'>", "&lt;a &amp; &#x27;b&#x27;&gt;"),
    (text.leading_id, "https://x/y?id=42&z=1", "42"),
    (text.leading_id, " 17 ", "17"),
    (text.leading_id, "x17", None),
    (text.question_list, "7, 8, 18 and23", [7, 8, 18, 23]),
    (text.option_lines, "Which?\nA one B two C three D four", "Which?\nA one\nB two\nC three\nD four"),
    (text.latex, "ΔH₁⦵ of CH₄ and [PCl₄]⁺ is A", r"$\Delta H_{1}^{\ominus}$ of $\mathrm{CH_{4}}$ and $\mathrm{[PCl_{4}]^{+}}$ is A"),
    (text.latex, None, None),
    (text.latex, "ΔH_{f}^{⦵} is 5, ΔHc° and ΔH for Na+ ions (Fe2+, SO₄²⁻) In H2O.", r"$\Delta H_{\mathrm{f}}^{\ominus}$ is 5, $\Delta H_{\mathrm{c}}^{\ominus}$ and $\Delta H^{\ominus}$ for Na+ ions ($\mathrm{Fe_{2}^{+}}$, SO₄²⁻) In H2O."),
    (text.latex, "NaCl(aq) + H2O → Hello C6H12O6; I2, [Fe(CN)6] OH- and NH4+ x", r"$\mathrm{NaCl}$(aq) + $\mathrm{H_{2}O}$ → Hello $\mathrm{C_{6}H_{12}O_{6}}$; I2, [Fe(CN)6] $\mathrm{OH^{-}}$ and $\mathrm{NH_{4}^{+}}$ x"),
    (text.option_lines, "Which?A one  B two\tC x y D four five ", "Which?\nA one\nB two\nC x y\nD four five"),
    (text.option_lines, "A B two C three D four\n A  B C D \nA one B two C three D", "A B two C three D four\nA\nB\nC\nD\nA one B two C three D"),
    (text.option_lines, "kelvinA one B two C three D four", "kelvinA one B two C three D four"),
])
def test_functions(spark, f, value, want):
    assert one(spark, value, f) == want


@pytest.mark.parametrize("value,want", [(None, True), (" ", True), ("x 1 1 1 1 1 1", True), ("Marks Marks x", True), ("A fine answer; M1", False), ("1\na\n1\nb\n1\nc\n1\nd\n1\ne\n1\nf\n1\ng\n1\n", True), ("M1 1\na\n1\nb\n1\nc\n1\nd\n1\ne\n1\nf\n1\ng\n1\n", False)])
def test_garbage(spark, value, want):
    assert one(spark, value, text.garbage) is want


def test_style(spark):
    assert one(spark, "Paper 1 Multiple Choice", text.paper_style) == "mcq"
    assert one(spark, "\n".join("A x" for _ in range(40)), text.paper_style) == "mcq"
    assert one(spark, "Answer all questions.", text.paper_style) == "structured"


def test_notes(spark):
    note = "---\nid: x\n---\n# T\n## Question\nstem\nmore\n## Mark scheme\nC\n"
    got = one(spark, note, text.front_and_body)
    assert got.front == "id: x" and got.body.startswith("# T")
    assert one(spark, note, lambda c: text.section(c, "Question")) == "stem\nmore" and one(spark, note, lambda c: text.section(c, "Mark scheme")) == "C"


def test_words(spark):
    words = text.distinctive_words(F.col("v"), ["with"], 3)
    df = spark.createDataFrame([("Heat with heat ENERGY cycle bond",)], "v string")
    assert df.select(words, text.word_hits(words, F.lit("the cycle of energy"))).first()[:] == (["heat", "energy", "cycle"], 2)


@pytest.mark.parametrize("body,codes", [("Use Hess's law.\nA catalyst", ["5.1", "5.2"]), ("The Boltzmann curve", ["8.2"]), ("What is it?\nA catalyst\nB two\nC three\nD four", ["2.2"]), ("C2H6 is organic", ["13.1"]), ("", ["2.2"])])
def test_first_rule_that_matches(spark, body, codes):
    assert one(spark, body, lambda c: classify.first_match(classify.stem_of(c), c)).codes == codes


PAPER = """Answer all questions.
----- PAGE 2 -----
1 (a) State what is meant by energy of the first kind.
(b) This part is about bonds.
(i) Define bond energy in words.
(ii) Calculate it from the table given.
© UCLES 2021
----- PAGE 3 -----
2 The reaction of an acid with a base is studied here.
(a) Write an equation for it.
[Total: 5]
9 marks
(b) Explain it.
"""
MARKS = """Mark scheme
1(a)
energy per mole M1
1(b)(i)
first M1
----- PAGE 2 -----
1(b)(ii)
second
2(a)
old
2(a)
equation
"""


def test_paper_to_parts(spark):
    docs = spark.createDataFrame([("d", PAPER), ("empty", ""), ("none", "no numbers here")], "doc string, text string")
    mains = split.questions(docs).orderBy("ord").collect()
    assert [(r.question, r.page, r.style) for r in mains] == [("1", 2, "structured"), ("2", 3, "structured")]
    assert "UCLES" not in mains[0].text and mains[1].text.endswith("(b) Explain it.")
    parts = {r.label: r.text for r in split.parts(split.questions(docs)).collect()}
    assert set(parts) == {"1(a)", "1(b)(i)", "1(b)(ii)", "2(a)", "2(b)"}
    assert "bonds" in parts["1(b)(ii)"] and "Define" not in parts["1(b)(ii)"] and "bonds" not in parts["1(a)"]
    assert parts["2(a)"].startswith("2 The reaction")


def test_marks(spark):
    docs = spark.createDataFrame([("d", MARKS)], "doc string, text string")
    blocks = split.mark_blocks(docs)
    got = {r.label: r.block for r in blocks.collect()}
    assert set(got) == {"1(a)", "1(b)(i)", "1(b)(ii)", "2(a)"} and got["2(a)"].endswith("equation") and "PAGE" not in got["1(b)(i)"]
    mains = split.marks_by_parent(blocks)
    joined = {r.question: r.block for r in mains.collect()}
    assert joined["1"].index("energy per mole") < joined["1"].index("first") < joined["1"].index("second")
    chunks = spark.createDataFrame([("d", "1", "1(a)"), ("d", "1", "1(z)"), ("d", "2", None), ("d", "9", None)], "doc string, question string, label string")
    bound = {(r.question, r.label): r.mark_scheme for r in split.bind_marks(chunks, blocks, mains).collect()}
    assert "per mole" in bound["1", "1(a)"] and bound["1", "1(z)"] is None and "equation" in bound["2", None] and bound["9", None] is None


def test_key(spark):
    got = one(spark, "1 C 1\n2 B 1\nnoise\n12 D 1", text.answer_key)
    assert [(r.q, r.a) for r in got] == [("1", "C"), ("2", "B"), ("12", "D")]


SHAPED = "Which?\nPCl3 [PCl4]+\nA pyramidal square planar\nB Trigonal planar  bent\nC odd tetrahedral\nD linear x\nend"


@pytest.mark.parametrize("value,want", [
    (SHAPED, "Which?\n| | PCl3 | [PCl4]+ |\n| --- | --- | --- |\n| A | pyramidal | square planar |\n| B | Trigonal planar | bent |\n| C | odd | tetrahedral |\n| D | linear | x |\nend"),
    (SHAPED.replace("linear x", "linear"), None), (SHAPED.replace("PCl3", "the"), None), (SHAPED.replace("\nD linear x\nend", ""), None), ("", None),
    (SHAPED + "\n" + SHAPED, lambda t: t.count("| --- | --- | --- |") == 2),
])
def test_tables_of_shapes(spark, value, want):
    got = one(spark, value, text.options_table)
    assert want(got) if callable(want) else got == (value if want is None else want)


@pytest.mark.parametrize("value,figure,want", [
    ("The graph is shown.\nenthalpy\nprogress of reaction\n0 x\n4000 3000 2000\nWhat is T?", True, "The graph is shown.\nWhat is T?"),
    ("The graph is shown.\nenthalpy", False, "The graph is shown.\nenthalpy"),
    ("Which one is it?\nC H O\n⁺ –\nA one two\nB two", True, "Which one is it?\nA one two\nB two"),
    ("Which drawing is it?\nA\nB\nC\nD\nXY\n1 Zn", True, "Which drawing is it?\n1 Zn"),
    ("Which drawing is it?\nA B C D\nOH ZZ", True, "Which drawing is it?"),
    ("Which row is it?\nA ✓ ✗\nB ✗ ✓\nC ✓ ✓\nwords stay", True, "Which row is it?\nwords stay"),
    ("Why?\x01\nSection B\n\n1 only\nmore words\n© UCLES 2021", True, "Why?\nmore words"),
])
def test_labels_of_a_diagram(spark, value, figure, want):
    assert one(spark, value, lambda c: text.without_labels(c, F.lit(figure))) == want
