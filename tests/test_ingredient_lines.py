"""Lines of ingredients against what a reader takes from them."""

from larder.operators import ingredient_lines as il


def read(spark, *lines):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "id int, text string")
    out = {}
    for r in sorted(il.ingredients(df).collect(), key=lambda r: (r.id, r.part)):
        out.setdefault(r.id, []).append((r.name, r.quantity, r.unit, r.note, r.optional, r.check))
    return [out.get(i, []) for i in range(len(lines))]


def test_lines(spark):
    got = read(
        spark, "225 G DE PÂTES COURTES (ICI MEZZE MANICHE)", "½ courgette", "2 c. à soupe d'huile d'olive", "SEL ET POIVRE", "1 oignon, émincé", "bouillon de volaille ou de légumes",
        "2 à 3 gousses d'ail", "1 1/2 cs bombée de miel", "1 pleine cuillère à café de sel", "poivre au goût", "1,5 kg de pommes de terre (facultatif)", "2 grosses carottes", "1 grosse carotte", "", "(rien)", "3/4 l de lait",
    )
    assert got == [
        [("pâtes courtes", 225, "g", "ici mezze maniche", False, None)], [("courgette", 0.5, "piece", None, False, None)], [("huile d'olive", 2, "cas", None, False, None)],
        [("sel", None, None, None, False, None), ("poivre", None, None, None, False, None)], [("oignon", 1, "piece", "émincé", False, None)], [("bouillon de volaille", None, None, "ou de légumes", False, None)],
        [("ail", 2, "piece", "2 à 3, gousses", False, None)], [("bombée de miel", 1.5, "cas", None, False, None)], [("sel", 1, "cac", "pleine", False, None)], [("poivre", None, None, "au goût", False, None)],
        [("pommes de terre", 1.5, "kg", "facultatif", False, None)], [("grosses carottes", 2, "piece", None, False, None)], [("carotte", 1, "piece", "grosse", False, None)], [], [], [("lait", 0.75, "l", None, False, None)],
    ]


def test_doubtful(spark):
    a, b, c, d = (x[0] for x in read(spark, "227100 g de parmesan", "20 ci de crème", "60 kg de riz", "200 g de beurre ⚠ à relire"))
    assert a[:3] == ("parmesan", 100, "g")
    assert "227100" in a[5]
    assert b[:3] == ("crème", 20, "cl") and b[5] == il.MISREAD
    assert c[1] == 60 and "inhabituelle" in c[5]
    assert d == ("beurre", 200, "g", None, False, "à relire")


def test_section(spark):
    text = "Pour la pâte :\n• 250 g de farine\ntamisée\n\n• 3 œufs\nGarniture :\n- 2 pommes\n*\ne 10 g de sel\n??poivre"
    df = spark.createDataFrame([(1, text), (2, None), (3, ""), (4, "riz\nlong grain\nSel"), (5, "Sauce :\nSauce :\nriz")], "recipe long, text string")
    rows = sorted((r.recipe, r.n, r.group, r.text) for r in il.section_lines(df, "recipe").fillna("-", ["group"]).collect())
    assert rows == [
        (1, 1, "Pour la pâte", "250 g de farine tamisée"), (1, 2, "Pour la pâte", "3 œufs"), (1, 3, "Garniture", "2 pommes"), (1, 4, "Garniture", "10 g de sel"), (1, 5, "Garniture", "poivre"),
        (4, 1, "-", "riz long grain"), (4, 2, "-", "Sel"), (5, 1, "Sauce", "riz"),
    ]
