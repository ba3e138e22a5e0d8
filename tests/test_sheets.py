"""Labels of sheets against answers written out by hand, and labels that must get nothing."""

from pyspark.sql import types as T

from larder.operators import sheets

LABELS = (
    "Sauge", "oignons", "Oignons rouges émincés", "Parmesan râpé 24 mois", "courgeties", "Pâte à tartiner", "penne", "vin blanc", "Poivron vert", "curry rouge", "", "Huile d’olive vierge extra", "tomates", "Filet",
    "crème fraiche épaisse", "lardon maison", "champignnons de paris",
)
INGREDIENTS = (
    "Oignon jaune", "Oignon rouge", "Sauge fraîche", "Parmesan", "Courgette", "Pâtes (spaghetti, penne…)", "Vin rouge", "Poivron", "Huile d'olive", "Tomates cerises", "Tomates pelées en conserve", "Filet de poulet", "Filet de dinde",
    "Crème fraîche épaisse", "Lardons fumés", "Champignons de Paris",
)
LEARNED = {"lardon maison": "Lardons fumés"}


def test_stages(spark):
    labels, names = spark.createDataFrame(list(enumerate(LABELS)), "id long, label string"), spark.createDataFrame([(x,) for x in INGREDIENTS], "name string")
    found = sheets.match_labels(labels, names, spark.createDataFrame(list(LEARNED.items()), "key string, name string"))
    got = {LABELS[r.id]: (r.ingredient, r.via) for r in found.collect()}
    assert got["Sauge"] == ("Sauge fraîche", "partiel")
    assert got["oignons"] == ("Oignon jaune", "synonyme")
    assert got["lardon maison"] == ("Lardons fumés", "alias")
    assert got["Parmesan râpé 24 mois"] == ("Parmesan", "nom")
    assert got["courgeties"] == ("Courgette", "approchant")
    for label in ("Pâte à tartiner", "vin blanc", "tomates", "Filet", "curry rouge", ""):
        assert got[label] == (None, None)


def test_nulls_and_no_names(spark):
    labels = spark.createDataFrame([(1, None), (2, "de la"), (2, "sel")], "id long, label string")
    none = spark.createDataFrame([], T.StructType([T.StructField("name", T.StringType())]))
    aliases = spark.createDataFrame([], "key string, name string")
    got = sheets.match_labels(labels, none, aliases).collect()
    assert sorted(r.id for r in got) == [1, 2, 2]
    assert all(r.ingredient is None and r.candidates == "" for r in got)
