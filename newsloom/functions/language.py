"""Language by script and stop words, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: Stop words of each language; of equal counts the first language wins.
WORDS = {
    "en": "the and to of in for on with is are this that it as be at by from or an was were not have has",
    "es": "el la de y en que los del se las por un para con no una es al lo como",
    "fr": "le la les de des et en du un une pour que est dans par sur pas plus au aux",
    "de": "der die das und ist in den von zu mit auf für ein eine nicht dem des als auch",
    "it": "il la di e in che per un una del della con non si le al come più da",
    "pt": "o a de e que do da em para com não uma os as por é se mais como",
    "ru": "и в не на что это как для по из с к или но я он она мы вы они",
    "uk": "і в не на що це як для по з та або але я він вона ми ви вони",
}
_LETTERS = r"A-Za-zÀ-ɏЀ-ӿႠ-ჿ'"


def _among(words: str):
    return lambda w: w.isin(*words.split())


def _once(value: Column, use) -> Column:
    """use(value), with value worked out once: as a lambda's variable the optimizer can't repeat it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def detect(text: Column) -> Column:
    """struct<code, confidence>. Georgian or Cyrillic letters decide by their share of the letters of both scripts."""
    value = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"https?://\S+", " ")
    value = F.trim(F.regexp_replace(F.regexp_replace(value, rf"(?U)[^\w{_LETTERS}]+", " "), r"\s+", " "))
    words = lambda v: F.regexp_extract_all(v, F.lit(f"([{_LETTERS}]+)"), 1)
    return _once(value, lambda v: _once(words(v), lambda w: _once(_counts(v, w), _decided)))


def _counts(value: Column, words: Column) -> Column:
    """What the decision needs of a text and its words, as numbers."""
    georgian, cyrillic = (F.char_length(value) - F.char_length(F.regexp_replace(value, f"[{c}]", "")) for c in (r"Ⴀ-ჿ", r"Ѐ-ӿ"))
    plain, all_letters = F.char_length(F.regexp_replace(value, "[^a-z]", "")), F.char_length(F.regexp_replace(value, r"[^\p{L}]", ""))
    score = [F.size(F.filter(words, _among(s))).alias(code) for code, s in WORDS.items()]
    return F.struct(F.char_length(value).alias("length"), F.size(words).alias("words"), georgian.alias("georgian"), cyrillic.alias("cyrillic"), plain.alias("plain"), all_letters.alias("all_letters"), *score)


def _decided(x: Column) -> Column:
    letters = x["georgian"] + x["cyrillic"]
    share_ka, share_cy = (F.when(letters > 0, n / F.greatest(letters, F.lit(1))).otherwise(0.0) for n in (x["georgian"], x["cyrillic"]))

    def best(codes: list[str]) -> tuple[Column, Column]:
        top = F.greatest(*[x[c] for c in codes])
        name = F.lit(codes[-1])
        for c in reversed(codes[:-1]):
            name = F.when(x[c] == top, c).otherwise(name)
        return name, top

    latin, latin_top = best(["en", "es", "fr", "de", "it", "pt"])
    slav, slav_top = best(["ru", "uk"])

    def out(code: Column | str, confidence: Column | float) -> Column:
        code = F.lit(code) if isinstance(code, str) else code
        confidence = F.lit(float(confidence)) if isinstance(confidence, (int, float)) else confidence
        return F.struct(code.alias("code"), F.round(F.least(F.lit(0.99), confidence), 3).alias("confidence"))

    return (
        F.when(x["length"] == 0, out("und", 0.0))
        .when((x["words"] < 2) & (x["length"] < 8), out("und", 0.15))
        .when(share_ka >= 0.12, out("ka", 0.72 + share_ka * 1.5))
        .when((share_cy >= 0.12) & (slav_top == 0), out("ru", 0.76 + F.least(F.lit(0.12), share_cy * 0.15)))
        .when(share_cy >= 0.12, out(slav, 0.72 + F.least(F.lit(0.22), slav_top * 0.12) + F.least(F.lit(0.06), share_cy * 0.2)))
        .when((latin_top == 0) & (x["all_letters"] > 0) & (x["plain"] >= 0.8 * x["all_letters"]), out("en", 0.55))
        .when(latin_top == 0, out("und", 0.2))
        .otherwise(out(latin, 0.68 + F.least(F.lit(0.28), latin_top * 0.18)))
    )


def script(text: Column) -> Column:
    value = F.coalesce(text, F.lit(""))
    parts = [(value.rlike(r), n) for r, n in ((r"[A-Za-zÀ-ɏ]", "latin"), (r"[Ѐ-ӿ]", "cyrillic"), (r"[Ⴀ-ჿ]", "georgian"))]
    several = sum((c.cast("int") for c, _ in parts[1:]), parts[0][0].cast("int"))
    out = F.when(several > 1, "mixed")
    for c, name in parts:
        out = out.when(c, name)
    return out.otherwise("unknown")
