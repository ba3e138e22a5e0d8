"""Steps of preparations against answers by hand, one layout after the other."""

from larder.operators import steps

CASES = {
    "1\n\nCoupez et mélangez-\nles bien.\n\nPub\n2\nServez.\n\nFin": ("alone", ["Coupez et mélangez-les bien.", "Servez."], None, []),
    "Avant\nÉtape 1 : Coupez.\n\nCuisez.\n2) Salez\nbien.\n\nSite": ("prefixed", ["Coupez. Cuisez.", "Salez bien."], None, [steps.LEFT_OUT]),
    "étape 1\nA.\nÉTAPE 2\n\nB.": ("prefixed", ["A.", "B."], None, []),
    "1 Coupez\nfin.\n\n2 Salez.\nEncore.\n\nFin": ("middle", ["Coupez fin.", "Salez. Encore."], None, []),
    "Coupez les\n1 oignons.\nSalez puis\n2 poivrez.": ("middle", ["Coupez les oignons.", "Salez puis poivrez."], None, []),
    "Coupez\n1 tout.\nsans\nfin\n2 alors.": ("middle", ["Coupez tout. sans", "fin alors."], None, [steps.UNSURE.format(1)]),
    "Coupez\n1 tout.\n\nreste\n\nSalez\n2 bien.\nA.\nB.": ("middle", ["Coupez tout. reste", "Salez bien. A."], None, [steps.UNSURE.format(1), steps.LEFT_OUT]),
    "Avant\n• Coupez.\n\nbien\n- Salez.": ("bullets", ["Coupez. bien", "Salez."], None, []),
    "Coupez.\nSalez.\n\n\nServez.": ("paragraphs", ["Coupez. Salez.", "Servez."], None, []),
    "a\nb\nc\nd": ("paragraphs", ["a b c d"], None, [steps.ONE_BLOCK]),
    "1 Coupez.\n« Prenez des\n2 Salez\n\nfraises.\nmûres »\n\nbien.": ("middle", ["Coupez.", "Salez fraises."], "Prenez des mûres", []),
    "« Une astuce »": ("none", [], "Une astuce", [steps.NO_STEPS]),
    "« Jamais fermé\n\nCuire.": ("paragraphs", ["« Jamais fermé", "Cuire."], None, []),
    " \n\n": ("none", [], None, [steps.NO_STEPS]),
    "": ("none", [], None, [steps.NO_STEPS]),
    None: ("none", [], None, [steps.NO_STEPS]),
    "2\nB.\n1\nA.": ("paragraphs", ["2 B. 1 A."], None, [steps.ONE_BLOCK]),
}


def test_layouts(spark):
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(CASES)], "id int, text string, layout string")
    got = {r.id: (r.layout, r.steps, r.tip, r.issues) for r in steps.steps(df, "id").collect()}
    for i, (text, answer) in enumerate(CASES.items()):
        assert got[i] == answer, text


def test_long_text(spark):
    many = "\n".join(f"{n}. Mélangez {n} fois.\nServez." for n in range(1, 2001))
    row = steps.steps(spark.createDataFrame([(1, many)], "id int, text string"), "id").first()
    assert row.layout == "prefixed" and len(row.steps) == 2000 and row.steps[-1] == "Mélangez 2000 fois. Servez."
