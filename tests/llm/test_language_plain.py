"""Language prediction against a plain version: dictionaries of n-grams, one text and one centroid at a time."""
import math

import numpy as np

from feedspark.llm import language

TEXTS = {"en": "the cat and the dog are on the mat with that this these", "es": "el gato y el perro de la casa que los las una por", "de": "der hund und die katze sind nicht auf dem haus mit ein"}


def grams(text):
    """{bucket: count} of the hashed n-grams of the text in lower case between two spaces."""
    codes = [32 if ord(c) < 0x370 and not c.isalpha() else ord(c) for c in f" {text.lower()} "]
    out = {}
    for n in range(1, language.NGRAMS + 1):
        for i in range(len(codes) - n + 1):
            h = 0
            for k in range(n):
                h = (h + codes[i + k] * language.MULTIPLIERS[k]) % 2**32
            bucket = ((h * 0x27D4EB2F % 2**32) ^ ((n - 1) * 0x165667B1 % 2**32)) >> (32 - language.BITS)
            out[bucket] = out.get(bucket, 0) + 1
    return out


def test_predictions_equal_a_plain_version():
    rng = np.random.default_rng(2)
    train = [(lang, " ".join(rng.choice(t.split(), 12))) for lang, t in TEXTS.items() for _ in range(40)]
    counted = [grams(t) for _, t in train]
    idf = np.array([math.log((1 + len(train)) / (1 + sum(b in c for c in counted))) + 1 for b in range(language.DIM)], np.float32)
    model = language.fit([t for _, t in train], [lang for lang, _ in train], idf)
    asked = [" ".join(rng.choice(t.split(), n)) for t in TEXTS.values() for n in (1, 3, 9, 30)] + ["", "1 2 3", "² ½ ① Ⅷ", "日本語 テキスト", "zzz qqq xxx", "é"]
    lang, score, rejected = model.predict(asked)
    for text, got, s, no in zip(asked, lang, score, rejected):
        if not any(c.isalpha() for c in text):
            assert (got, s, no) == ("und", 0.0, True)
            continue
        weight = {b: math.log1p(n) * float(idf[b]) for b, n in grams(text).items()}
        length = math.sqrt(sum(w * w for w in weight.values()))
        cosines = [sum(w * float(center[b]) for b, w in weight.items()) / length for center in model.centers]
        assert abs(max(cosines) - s) < 1e-4 or max(cosines) < 0 and s == 0
        ordered = sorted(cosines)
        if ordered[-1] - ordered[-2] > 1e-4:
            assert got == model.language[int(np.argmax(cosines))]
        floor = model.floor[min(language.SIZES - 1, len(text).bit_length())]
        if abs(max(cosines) - floor) > 1e-4:
            assert no == (max(cosines) < floor)
