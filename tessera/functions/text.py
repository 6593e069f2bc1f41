"""Text and classification expressions, Column to Column, native throughout."""

from __future__ import annotations

import itertools
import json
import unicodedata
from html.entities import name2codepoint

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values that decide results, stated as they must be: words without identity in a title, negations, words of nearness.
STOPWORDS = "ban can nha gap gia tot re chinh chu ty trieu m2 m dt o tai va co cho voi duong quan q phuong p tp huyen x lh nhanh dep ngay".split()
NEGATIONS = "khong ko k kh chua thieu".split()
NEAR = "gan cach sat ra toi den vai thong".split()
MISSING = ("null", "none", "nan", "na", "")


def _folding() -> tuple[str, str]:
    """Letters with marks and their base letters, from Unicode's decompositions."""
    pairs = []
    for code in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]:
        base = "".join(c for c in unicodedata.normalize("NFKD", chr(code)) if not unicodedata.combining(c))
        if len(base) == 1 and base.isascii() and base != chr(code):
            pairs.append((chr(code), base.lower()))
    pairs += [("đ", "d"), ("Đ", "d")]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


ACCENTED, PLAIN = _folding()


def let(c: Column, f) -> Column:
    """f(c) with c computed once, however often f uses it: expressions stay small and are not compiled many times over."""
    return F.get(F.transform(F.array(c), f), F.lit(0))


def _composing() -> dict[str, str]:
    """Letters and marks, in any order and partly composed, to the composed letter, by Unicode's own rules."""
    out: dict[str, str] = {}
    for code in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]:
        char = chr(code)
        base, *marks = unicodedata.normalize("NFD", char)
        for order in itertools.permutations(marks) if marks else ():
            for k in range(len(order)):
                head = unicodedata.normalize("NFC", base + "".join(order[:k]))
                key = head + "".join(order[k:])
                if key != char and unicodedata.normalize("NFC", key) == char:
                    out[key] = char
    return out


COMPOSED, ENTITIES = _composing(), {f"&{n};": chr(k) for n, k in name2codepoint.items()}


def _literal_map(pairs: dict[str, str]) -> Column:
    """One literal, however many pairs: each lit() is a call to the JVM."""
    return F.from_json(F.lit(json.dumps(pairs)), "map<string,string>")


def composed(c: Column) -> Column:
    """Letters and their combining marks as single characters; texts without such marks, nearly all, take no time."""
    known = _literal_map(COMPOSED)
    piece = lambda p: F.when(F.length(p) > 1, F.coalesce(known[p], p)).otherwise(p)
    return F.when(c.rlike(r"\p{M}"), F.array_join(F.transform(F.regexp_extract_all(c, F.lit(r"(?s)(\P{M}\p{M}*|\p{M}+)"), F.lit(1)), piece), "")).otherwise(c)


def unescaped(c: Column) -> Column:
    """Named and numeric character references decoded; texts without an ampersand, nearly all, take no time."""
    named = _literal_map(ENTITIES)

    def numeric(p: Column) -> Column:
        digits = F.regexp_extract(p, r"^&#[xX]?([0-9a-fA-F]+);$", 1)
        code = F.when(p.rlike(r"^&#[xX]"), F.conv(digits, 16, 10)).otherwise(digits).try_cast("int")
        return F.when(code.between(1, 0x10FFFF) & ~code.between(0xD800, 0xDFFF), F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")).otherwise(p)

    piece = lambda p: F.when(p.startswith("&#"), numeric(p)).when(p.startswith("&"), F.coalesce(named[p], p)).otherwise(p)
    parts = F.regexp_extract_all(c, F.lit(r"(?s)(&#[xX][0-9a-fA-F]{1,6};|&#[0-9]{1,7};|&[A-Za-z][A-Za-z0-9]*;|[^&]+|&)"), F.lit(1))
    return F.when(c.contains("&"), F.array_join(F.transform(parts, piece), "")).otherwise(c)


def clean_text(c: Column) -> Column:
    """Character references decoded, letters composed, control characters dropped, white space collapsed; words for nothing become null."""
    c = composed(unescaped(c))
    c = F.trim(F.regexp_replace(F.regexp_replace(c, r"[\p{C}&&[^\t\r\n]]", ""), r"(?U)\s+", " "))
    return let(c, lambda x: F.when(~F.lower(x).isin(*MISSING), x))


def fold(c: Column) -> Column:
    """Lower case without diacritics; what is neither letter nor digit is one space."""
    c = F.replace(F.lower(F.translate(F.regexp_replace(c, r"\p{M}+", ""), ACCENTED, PLAIN)), F.lit("ß"), F.lit("ss"))
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"[^a-z0-9]+", " "))


# Where the mark of two vowels stands, the older way and the one used here.
TONES = dict(zip("òa óa ỏa õa ọa òe óe ỏe õe ọe ùy úy ủy ũy ụy".split(), "oà oá oả oã oạ oè oé oẻ oẽ oẹ uỳ uý uỷ uỹ uỵ".split(), strict=True))


def accented(c: Column) -> Column:
    """Lower case with diacritics, composed, marks of two vowels in one place; punctuation is one space."""
    c = F.lower(composed(F.coalesce(c, F.lit(""))))
    for old, new in TONES.items():
        c = F.replace(c, F.lit(old), F.lit(new))
    return F.trim(F.regexp_replace(c, r"(?U)[\W_]+", " "))


def title_tokens(c: Column) -> Column:
    """Sorted distinct words of the folded title, without stop words and single letters."""
    words = F.filter(F.split(fold(c), " "), lambda w: F.length(w) > 1)
    return F.array_sort(F.array_distinct(F.array_except(words, F.array(*map(F.lit, STOPWORDS)))))


def jaccard(a: Column, b: Column) -> Column:
    """Share of common elements; 0 for two empty arrays."""
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(F.lit(0.0))


def any_of(patterns: list[str]) -> str:
    """A regex for whole words of folded text that match one of patterns."""
    return rf"(?:^| )(?:{'|'.join(patterns)})(?= |$)"


def unnegated(patterns: list[str], before: str = "", after: str = "") -> str:
    """Like any_of, unless one of the two words before negates it; before and after add conditions."""
    no = "|".join(NEGATIONS)
    return rf"(?<!(?:^| )(?:{no}) )(?<!(?:^| )(?:{no}) [a-z0-9]{{1,20}} ){before}(?<=^| )(?:{'|'.join(patterns)})(?= |$){after}"


def negated(patterns: list[str]) -> str:
    no = "|".join(NEGATIONS)
    return rf"(?:^| )(?:{no}) (?:[a-z0-9]+ )?(?:{'|'.join(patterns)})(?= |$)"


# What titles say about five features, on folded text; they must be these for the same results.
FEATURES = {
    "legal": (["so hong", "so do", "shr", "so rieng", "so san", "phap ly (?:ro rang|chuan|day du|sach|minh bach)", "cong chung", "sang ten", "so dep", "so vuong", "tho cu", "san so", "hoan cong", "bao phap ly"], ["giay tay", "vi bang", "so chung", "chua (?:co )?so", "khong (?:co )?so", "cho so", "dang (?:cho|lam) so"]),
    "furnished": (["full noi that", "noi that (?:sieu |rat |cuc )?(?:cao cap|day du|xin|dep|sang trong|nhap khau|go)", "day du noi that", "ntcc", "full nt", "full do", "tang (?:toan bo |lai |kem )?noi that", "kem noi that", "fully furnished", "furnished"], ["ban giao tho", "nha tho moi", "khong noi that", "noi that co ban"]),
    "frontage": (["mat tien", "mt", "mtkd", "mat pho", "mat duong", "mat tien kinh doanh", "[2-4] ?mt"], []),
    "elevator": (["thang may"], []),
    "car_access": (["hem xe hoi", "hxh", "hem o to", "hem oto", "ngo o to", "ngo oto", "(?:o to|oto|xe hoi) (?:vao|do|ngu|dau|tranh|toi|den)", "duong (?:o to|oto|xe hoi)", "hem xe tai", "xe hoi tan cua", "o to tan cua", "oto tan cua", "hem xa tai"], []),
}
# Short forms that only their marks tell apart, and negations as they are written with marks.
_MARKED, _NO = "sđ|sđcc|có sổ", "(?:không|khong|ko|k|kh|chưa|chua|thiếu|thieu)"


def _said(text: Column) -> Column:
    """Whether accented text has a short form that neither of the two words before it negates."""
    return text.rlike(rf"(?<!(?:^| ){_NO} )(?<!(?:^| ){_NO} [^ ]{{1,20}} )(?<=^| )(?:{_MARKED})(?= |$)")


# What may not follow a street side, and words of categories in labels and titles.
NOT_STREET = r"(?! ?(?:\d+(?: \d+)? ?m\b|hem|ngo|kiet|bo (?:song|ho|bien)|song|bien))"
CATEGORIES = (
    ("can_ho", ["can ho", "chung cu", "condotel", "officetel", "offictel", "apartment", "penthouse", "duplex", "tap the"]),
    ("biet_thu", ["biet thu", "villa", "lien ke", "shop ?house", "nha vuon"]),
    ("phong_tro_khac", ["phong tro", "nha tro", "phong", "kho", "xuong", "mat bang", "van phong", "thuong mai", "commercial", "khach san", "cua hang", "ki ot", "kiot", "trang trai", "nghi duong"]),
    ("dat", ["dat", "land"]),
    ("nha_pho", ["nha o", "nha pho", "nha rieng", "nha mat", "nha hem", "nha ngo", "nha nguyen can", "nha cap 4", "house", "nha"]),
)
STRONG = (
    ("phong_tro_khac", ["chdv", "can ho dich vu", "ccmn", "phong tro", "nha tro", "kho", "xuong", "nha xuong", "mat bang", "van phong", "building", "khach san", "trang trai", "nghi duong"]),
    ("biet_thu", ["biet thu", "villa", "lien ke", "shop ?house", "nha vuon"]),
    ("can_ho", ["can ho", "chung cu", "condotel", "officetel", "penthouse", "duplex", "studio", r"can (?:goc )?\d+ ?pn"]),
    ("dat", ["ban dat", "lo dat", "dat nen", "dat tho cu", "manh dat", "thua dat", "nen dat", "dat vuon", "dat nong nghiep", "dat o"]),
    ("nha_pho", ["nha", r"\d+ ?(?:tang|lau)", "tret", "nha cap 4", "nha nguyen can", "mtkd", "nha mat tien", "nha mat pho"]),
)
WEAK = (("biet_thu", ["lk"]), ("can_ho", ["ch", "cc", r"\d+ ?pn"]), ("dat", ["lo", "nen", "tho cu"]), ("nha_pho", ["mat tien", "mt", "hem", "hxh", "ngo", "lau"]))


def feature_status(feature: str, title: Column) -> Column:
    """POSITIVE, NEGATIVE or null where the title does not say."""
    return let(fold(title), lambda folded: _status(feature, folded, title))


def _status(feature: str, folded: Column, title: Column) -> Column:
    positive, negative = FEATURES[feature]
    near = rf"(?<!(?:^| )(?:{'|'.join(NEAR)}) )"
    if feature == "frontage":
        yes = folded.rlike(unnegated(positive, near, NOT_STREET))
    elif feature == "car_access":
        yes = folded.rlike(unnegated(positive)) | folded.rlike(unnegated(["o to", "oto", "xe hoi"], near))
    elif feature == "elevator":
        tm = folded.rlike(unnegated(["tm"])) & folded.rlike(any_of([r"\d+ ?(?:tang|lau|t)", "tang", "lau"])) & ~folded.rlike(r"(?:^| )tm (?:dv|dich vu)(?: |$)|(?:^| )(?:dat|khu|tttm) tm(?: |$)")
        yes = folded.rlike(unnegated(positive)) | tm
    elif feature == "legal":
        text = accented(title)
        plan = text.contains("sơ đồ") & ~text.contains("sổ đỏ")  # a floor plan folds to the same letters
        yes = F.when(plan, folded.rlike(unnegated([p for p in positive if p != "so do"]))).otherwise(folded.rlike(unnegated(positive))) | _said(text)
    else:
        yes = folded.rlike(unnegated(positive))
    words = positive + (["o to", "oto", "xe hoi"] if feature == "car_access" else [])
    no = folded.rlike(negated(words))
    if feature == "legal":
        no |= accented(title).rlike(rf"(?:^| ){_NO} (?:\S+ )?(?:{_MARKED})(?= |$)")
    out = F.when(yes, "POSITIVE").when(no, "NEGATIVE")
    return F.when(folded.rlike(any_of(negative)), "NEGATIVE").otherwise(out) if negative else out


def category_from_label(label: Column) -> Column:
    """The first category whose words the label has."""

    def first(folded: Column) -> Column:
        out = F.lit(None).cast("string")
        for name, patterns in reversed(CATEGORIES):
            out = F.when(folded.rlike(any_of(patterns)), name).otherwise(out)
        return out

    return let(fold(label), first)


def category_from_title(title: Column) -> Column:
    """struct(category, evidence): the most specific strong signal, else a weak one if it is the only kind."""
    return let(fold(title), _from_folded)


def _from_folded(folded: Column) -> Column:
    strong = F.lit(None).cast("string")
    for name, patterns in reversed(STRONG):
        strong = F.when(folded.rlike(any_of(patterns)), name).otherwise(strong)
    weak = F.filter(F.array(*[F.when(folded.rlike(any_of(p)), F.lit(n)) for n, p in WEAK]), lambda x: x.isNotNull())
    return F.struct(F.coalesce(strong, F.when(F.size(weak) == 1, F.get(weak, F.lit(0)))).alias("category"), F.when(strong.isNotNull(), "STRONG").when(F.size(weak) == 1, "WEAK").alias("evidence"))


# Which categories are of a kind, and what names a whole building of rooms.
FAMILY = {"nha_pho": "building", "biet_thu": "building", "phong_tro_khac": "building", "can_ho": "apartment", "dat": "land"}
SERVICE_BUILDING = ["chdv", "can ho dich vu", "ccmn"]


def model_category(label: Column, title: Column, evidence: Column) -> Column:
    """struct(category, method, conflict): the label's category unless a strong title is of another kind or names a building of rooms."""

    def decided(x: Column) -> Column:
        a, b = x["label"], x["title"]["category"]
        family = _literal_map(FAMILY)
        conflict = F.coalesce((x["title"]["evidence"] == "STRONG") & (family[a] != family[b]), F.lit(False))
        endpoint = F.coalesce(evidence == "ENDPOINT_CONTEXT", F.lit(False))
        service = F.coalesce((a != "phong_tro_khac") & (b == "phong_tro_khac"), F.lit(False)) & fold(title).rlike(any_of(SERVICE_BUILDING))
        made = lambda c, m, k: F.struct(c.alias("category"), (F.lit(m) if isinstance(m, str) else m).alias("method"), F.lit(k).alias("conflict"))
        out = F.when(service, made(b, "TITLE_SERVICE_BUILDING", True)).when(conflict, made(b, F.when(endpoint, "TITLE_OVER_ENDPOINT").otherwise("TITLE_OVER_LABEL"), True))
        out = out.when(a.isNotNull(), made(a, F.when(endpoint, "ENDPOINT_CONTEXT").otherwise("CATEGORY_NAME"), False))
        return out.when(b.isNotNull(), made(b, "TITLE_FALLBACK", False)).otherwise(made(F.lit("khong_ro"), "UNMAPPED", False))

    return let(F.struct(category_from_label(label).alias("label"), category_from_title(title).alias("title")), decided)
