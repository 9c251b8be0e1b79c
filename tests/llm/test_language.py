import zlib

from pyspark.sql import functions as F

from weftgraph.llm.language import fit_languages, identify
from weftgraph.llm.registry import op8_language

TEXTS = {
    "en": "the weather in the north was cold and the people of the town stayed at home with their books and their tea",
    "de": "das wetter im norden war kalt und die leute der stadt blieben mit ihren büchern und ihrem tee zu hause",
    "fr": "le temps dans le nord était froid et les gens de la ville restaient à la maison avec leurs livres et leur thé",
}


def test_small(docs_of):
    rows = [(i, t, k) for i, (k, t) in enumerate((k, t) for k, t in TEXTS.items() for _ in range(3))]
    train = docs_of([(i, t) for i, t, _ in rows]).drop("lang").join(docs_of([(0, "x")]).sparkSession.createDataFrame([(i, k) for i, _, k in rows], "doc_id long, lang string"), "doc_id")
    filters = fit_languages(train)
    assert filters.languages == ["de", "en", "fr"]
    probe = [(1, "the people and their books"), (2, "die leute und das wetter"), (3, "les gens de la ville"), (4, None), (5, ""), (6, "123 ... ###"), (7, "ééé"), (8, "…—„"), (9, "THE TOWN " * 30_000)]
    got = {r.doc_id: (r._lang_pred, r._score) for r in identify(docs_of(probe).withColumn("_score", F.lit("x")), filters).collect()}
    assert [got[i][0] for i in (1, 2, 3, 9)] == ["en", "de", "fr", "en"]
    assert [got[i] for i in (4, 5, 6, 8)] == [("und", 0.0)] * 4 and got[7][0] != "und"
    assert all(0 <= s <= 1 for _, s in got.values())
    assert identify(docs_of(probe).where("false"), filters).count() == 0
    nothing = fit_languages(train.where("false"))
    assert identify(docs_of([(1, "word")]), nothing).first()["_lang_pred"] == "und"


def test_held_out_accuracy(spark, con):
    folder = con[1]
    got = op8_language(spark, folder).join(spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in got if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    assert sum(r.lang == r.lang_pred for r in held) > 0.95 * len(held)


def brute(filters, text):
    """Language and score of one text, n-gram by n-gram, by the masks of the filters."""
    from weftgraph.llm.language import HASHES, SLOTS

    M = (1 << 64) - 1

    def mixed(x):
        x ^= x >> 30
        x = x * 0xBF58476D1CE4E5B9 & M
        x ^= x >> 27
        x = x * 0x94D049BB133111EB & M
        return x ^ (x >> 31)

    if not any(c.isalpha() for c in text or ""):
        return "und", 0.0
    raw = b" " + bytes(c + 32 if 65 <= c <= 90 else c if c >= 0x80 or 97 <= c <= 122 else 32 for c in text.encode()) + b" "
    grams = [(raw[i : i + 3], 0) for i in range(len(raw) - 2) if raw[i + 1] != 32]
    grams += [(raw[i : i + 4], 1 << 32) for i in range(len(raw) - 3) if raw[i + 1] != 32 and raw[i + 2] != 32]
    scores = []
    for k, name in enumerate(filters.languages):
        false, n = float(filters.false[k]), 0
        for g, kind in grams:
            h = mixed((int.from_bytes(g, "big") + kind + 0x5851F42D4C957F2D) & M)
            n += all(filters.masks[(h >> (32 * j) & 0xFFFFFFFF) % SLOTS, k // 8] >> (k % 8) & 1 for j in range(HASHES))
        scores.append((-min(1, max(0, (n - len(grams) * false) / (len(grams) * (1 - false)))), name))
    best = min(scores)
    return best[1], -best[0]


def test_scores_against_brute_force(spark, docs_of):
    """Nine languages, so that masks have two bytes; two of them are the same and tie."""
    import random

    r = random.Random(3)
    names = [*TEXTS, *"klmnop"]
    vocab = {k: TEXTS[k].split() if k in TEXTS else ["".join(r.choice("abcdeghéß") for _ in range(r.randint(2, 6))) for _ in range(20)] for k in names}
    vocab["p"] = vocab["o"]
    rows = [(i, " ".join(r.choice(vocab[k]) for _ in range(40)), k) for i, k in enumerate(names * 4)]
    rows += [(i + 500, t, "o" if k == "p" else "p") for i, t, k in rows if k in "op"]
    train = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    filters = fit_languages(train)
    assert len(filters.languages) == 9
    probe = [(i, t) for i, t, _ in rows[:40]] + [(700 + i, " ".join(r.choice(vocab[r.choice(names)]) for _ in range(9))) for i in range(40)] + [(800, None), (801, ""), (802, "a"), (803, "É! x"), (804, rows[0][1] * 500), (805, " ".join(vocab["o"]))]
    probe.append(probe[0])
    texts = dict(probe)
    found = identify(docs_of(probe), filters).collect()
    assert len(found) == len(probe)
    for x in found:
        name, score = brute(filters, texts[x.doc_id])
        assert x._lang_pred == name and abs(x._score - score) < 1e-9, x.doc_id
    assert next(x for x in found if x.doc_id == 805)._lang_pred == "o"
