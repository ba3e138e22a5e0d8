"""Printed receipts against what is on them."""

from larder.operators import receipts

# made up
SAMPLES = (
    (1, "MARCHE DU COIN\n07/10/2026 12:10\nLAIT 1L              1,05 A\n2 x 0,89\nYAOURT NATURE        1,78 A\nPOMMES VRAC          2,34 B\n0,936 kg x 2,50\nREMISE POMMES       -0,34\nLESSIVE              6,20 C\nSOUS TOTAL          11,03\nTOTAL               11,03 €\nCB                  11,03\nTVA A 5,50 %\nTVA B 5,50 %\nTVA C 20,00 %\nMERCI"),
    (2, "EPICERIE\nPAIN                 1,20\nFROMAGE 200G         3,45\nNOMBRE ARTICLES 3\nBEURRE ?????\nTOTAL A PAYER        6,90\n05.10.2026"),
    (3, "TICKET 12\nRIZ 1KG              2,10\nRIZ 1KG              2,10\nRABAIS               0,50-\nTOTAL                3,70"),
    (4, ""),
)

def test_articles(spark):
    df = spark.createDataFrame(list(SAMPLES), "receipt long, text string")
    got = [(r.receipt, r.n, r.label, r.qty, r.unit, r.cents, r.discount, r.rate, r.non_food, r.note) for r in sorted(receipts.parsed(df).collect(), key=lambda r: (r.receipt, r.n))]
    assert got == [
        (1, 1, "LAIT 1L", 1, "piece", 105, 0, 5.5, False, None), (1, 2, "YAOURT NATURE", 2, "piece", 178, 0, 5.5, False, None), (1, 3, "POMMES VRAC", 0.936, "kg", 234, 34, 5.5, False, None), (1, 4, "LESSIVE", 1, "piece", 620, 0, 20, True, None),
        (2, 1, "PAIN", 1, "piece", 120, 0, None, False, None), (2, 2, "FROMAGE 200G", 1, "piece", 345, 0, None, False, None), (2, 3, "BEURRE", 1, "piece", 225, 0, None, False, "deduced from the total"),
        (3, 1, "RIZ 1KG", 1, "piece", 210, 0, None, False, None), (3, 2, "RIZ 1KG", 1, "piece", 210, 50, None, False, None),
    ]
