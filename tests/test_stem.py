import pytest

from corpuslab.functions.stem import porter_stem
from corpuslab.operators import rouge as rg

# The examples of the published algorithm.
CASES = """caresses caress ponies poni ties tie cats cat feed feed agreed agre plastered plaster motoring motor sing sing
conflated conflat troubled troubl sized size hopping hop falling fall hissing hiss fizzed fizz failing fail filing file
happy happi sky sky relational relat conditional condit rational ration valenci valenc digitizer digit radicalli radic
differentli differ vileli vile analogousli analog vietnamization vietnam predication predic operator oper feudalism feudal
decisiveness decis hopefulness hope callousness callous formaliti formal sensitiviti sensit sensibiliti sensibl
triplicate triplic formative form formalize formal electriciti electr electrical electr hopeful hope goodness good
revival reviv allowance allow inference infer airliner airlin gyroscopic gyroscop adjustable adjust defensible defens
irritant irrit replacement replac adjustment adjust dependent depend adoption adopt homologou homolog communism commun
activate activ angulariti angular homologous homolog effective effect bowdlerize bowdler probate probat rate rate cease ceas
controll control roll roll dying die news news""".split()


@pytest.mark.parametrize("word,stem", list(zip(CASES[::2], CASES[1::2])))
def test_published_examples(word, stem):
    assert porter_stem(word) == stem


def test_stemmed_rouge(spark):
    pairs = spark.createDataFrame([(1, "the cats were running", "a cat runs"), (2, "", "x")],
                                  "k long, prediction string, reference string")
    st = {r["k"]: r for r in rg.stemmed_pairs(pairs, ["k"]).collect()}
    assert st[1]["prediction"] == "the cat were run" and st[1]["reference"] == "a cat run" and st[2]["prediction"] == ""
    r1 = {r["k"]: r["rouge1_precision"] for r in rg.rouge_n(rg.stemmed_pairs(pairs, ["k"]), ["k"], n=1).collect()}
    assert r1[1] == 0.5
