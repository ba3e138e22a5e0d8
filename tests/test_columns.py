"""Sheets of two columns against answers by hand."""

from larder.operators import columns


def test_columns(spark):
    mixed = "Tartiflette\n\nLes ingrédients La recette\n***\ne 1 reblochon Etape 1\n: Faire cuire les crozets dans l'eau bouillante\ne 200 g de lardons la crème fraîche.\n• 2 oignons Biepeaz\n- Couper l'oignon et le fromage\n?? sel la poêle\no 3 c. de crème d'abord\n‘ poivre\nCuire. Etape"
    want = "Tartiflette\n\n\nLes ingrédients\n- 1 reblochon\n- 200 g de lardons\n- 2 oignons\n- sel\n- 3 c. de crème\n- poivre\n\nLa recette\n\nEtape 1\nFaire cuire les crozets dans l'eau bouillante\nla crème fraîche.\n\nEtape 2\nCouper l'oignon et le fromage\nla poêle\nd'abord\nCuire. Etape"
    closed = "Ingrédients Préparation\n• sel la poêle\n• huile puis le reste.\n• 2 œufs Etape 7 Battre.\n• eau Etapez"
    none = ["Ingrédients\n• sel\nLa recette\nCuire.", "Les ingrédients La recette\nCuire.", "Les ingrédients La recette", "", None]
    df = spark.createDataFrame([(1, mixed, 0), (2, closed, 0)] + [(3 + i, t, 0) for i, t in enumerate(none)], "id int, text string, pos int")
    got = {r.id: r.text for r in columns.split_columns(df, "id").collect()}
    assert got[1] == want
    assert got[2] == "\nLes ingrédients\n- sel la poêle\n- huile\n- 2 œufs\n- eau\n\nLa recette\npuis le reste.\n\nEtape 7\nBattre.\n\nEtape 8"
    assert all(got[3 + i] is None for i in range(len(none))) and len(got) == 7
