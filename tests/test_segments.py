"""Words cut by a lexicon, against every way to cut them."""

import itertools

import numpy as np

from larder.operators import segments


def test_unglued(spark):
    lexicon = spark.createDataFrame([(x,) for x in ("avec", "un", "petit", "filet", "huile", "d", "olive", "pe", "tit", "carotte", "carottes", "sel", "s", "selon")], "piece string")
    texts = spark.createDataFrame([(1, "Avecunpetitfilet, d'huileolive!"), (2, "carottessel carottes avecxpetit"), (3, None), (4, ""), (5, "unfilet  Petitfilet\n12")], "id int, text string")
    got = {r.id: r.text for r in segments.unglued(texts, "id", "text", lexicon).collect()}
    assert got == {1: "Avec un petit filet, d'huile olive!", 2: "carottes sel carottes avecxpetit", 3: None, 4: "", 5: "unfilet  Petit filet\n12"}


def test_fewest(spark):
    rng = np.random.default_rng(3)
    pieces = sorted({"".join(rng.choice(list("ab"), rng.integers(1, 5))) for _ in range(12)})
    words = ["".join(rng.choice(list("ab"), rng.integers(8, 13))) for _ in range(60)]

    def best(word):
        for n in range(1, segments.MOST + 1):
            ways = []
            for inner in itertools.combinations(range(1, len(word)), n - 1):
                edge = [0, *inner, len(word)]
                if all(word[a:b] in pieces for a, b in itertools.pairwise(edge)):
                    ways.append((edge[-2::-1], " ".join(word[a:b] for a, b in itertools.pairwise(edge))))
            if ways:
                return min(ways)[1] if n > 1 else None
        return None

    got = {r.word: r.said for r in segments.cuts(spark.createDataFrame([(w,) for w in words], "word string"), spark.createDataFrame([(p,) for p in pieces], "piece string")).collect()}
    assert got == {w: b for w in words if (b := best(w))}
