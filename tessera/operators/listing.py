"""From three sources' raw rows to one observation table: 27 canonical columns, quality reasons, hash, completeness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import values as v
from tessera.functions.text import any_of, clean_text, feature_status, fold, let

#: Times without a zone of their own are local to the sources.
ZONE = "UTC+7"

# The canonical columns, in order.
CANONICAL = {
    "source": "string", "source_group": "string", "source_id": "string", "ad_id": "string", "title": "string", "price": "double", "price_str": "string", "area": "double", "rooms": "int",
    "address": "string", "ward": "string", "district_id": "string", "district_name": "string", "category_id": "string", "category_name": "string", "lat": "double", "lon": "double", "image": "string",
    "ad_url": "string", "source_url": "string", "posted_at": "timestamp", "scraped_at": "timestamp", "page_fetched": "int", "price_m": "double", "price_per_m2": "double", "has_coord": "boolean", "is_rent": "boolean",
}
# Categories by id, and how each source names them: by taxonomy number, by link, by product, by label, by words of a label.
NAMES = {
    "apartment": "Căn hộ chung cư", "house": "Nhà ở", "villa": "Biệt thự", "shophouse": "Shophouse", "condotel": "Condotel", "officetel": "Officetel", "land": "Đất",
    "commercial": "Bất động sản thương mại", "farm_resort": "Trang trại, khu nghỉ dưỡng", "other": "Bất động sản khác",
}
TAXONOMY = {"324": "apartment", "650": "apartment", "41": "house", "163": "house", "325": "villa", "575": "shophouse", "562": "condotel", "45": "commercial", "44": "farm_resort", "48": "other"}
LINKS = {"ban-can-ho-chung-cu": "apartment", "ban-nha-rieng": "house", "ban-nha-mat-pho": "house", "ban-nha-biet-thu-lien-ke": "villa", "ban-shophouse-nha-pho-thuong-mai": "shophouse", "ban-condotel": "condotel", "ban-kho-nha-xuong": "commercial", "ban-trang-trai-khu-nghi-duong": "farm_resort", "ban-loai-bat-dong-san-khac": "other"}
PRODUCTS = {"mua-ban-can-ho-chung-cu": "apartment", "mua-ban-nha-rieng": "house", "mua-ban-nha-mat-pho": "house", "mua-ban-dat": "land", "mua-ban-biet-thu": "villa", "mua-ban-shophouse": "shophouse", "mua-ban-condotel": "condotel", "mua-ban-kho-nha-xuong": "commercial", "mua-ban-van-phong": "commercial", "mua-ban-khu-nghi-duong-trang-trai": "farm_resort", "mua-ban-bat-dong-san-khac": "other"}
LABELS = (("land", ["đất thổ cư", "đất ở", "có thổ cư", "full thổ cư"]), ("officetel", ["offictel", "officetel"]), ("shophouse", ["shophouse"]), ("villa", ["biệt thự", "nhà biệt thự", "nhà vườn"]), ("house", ["nhà phố", "nhà nguyên căn", "nhà liền kề", "nhà cấp 4"]))
WORDS = (("officetel", ["officetel", "offictel"]), ("shophouse", ["shophouse"]), ("villa", ["biet thu", "villa"]), ("apartment", ["can ho", "chung cu", "apartment", "condotel"]), ("commercial", ["van phong", "mat bang", "kho nha xuong", "commercial"]), ("land", ["dat", "land"]), ("house", ["nha mat pho", "nha pho", "nha rieng", "nha o"]))
# What source groups are called, and where the sources keep times and coordinates.
CARD_GROUP, EXPORT_GROUP = "mua_ban_nha_mat_pho_mat_tien", "ban_can_ho_chung_cu"
POSTED, LATITUDE, LONGITUDE = ("published_info_text", "posted_text", "published_at", "posted_at"), ("lat", "latitude"), ("lon", "lng", "longitude")
# Parts of an address.
WARD, DISTRICT, CITY = r"(?iU)\b((?:Phường|Xã|Thị trấn)\s+[^,|]+)", r"(?iU)\b((?:Quận|Huyện|Thị xã)\s+[^,|]+)", r"(?iU)\b((?:Thành phố|TP\.?)\s+Thủ Đức)\b"


def _map(pairs: dict) -> Column:
    return F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])


def _col(df: DataFrame, name: str) -> Column:
    return F.col(f"`{name}`").cast("string") if name in df.columns else F.lit(None).cast("string")


def category_by_number(number: Column, link: Column) -> Column:
    """struct(id, evidence) by a taxonomy number, else by the beginning of a link's path."""
    path = F.regexp_replace(F.coalesce(clean_text(link), F.lit("")), "^https?://[^/]+/", "")
    by_link = F.coalesce(*[F.when(path.startswith(k), x) for k, x in LINKS.items()])
    return let(F.coalesce(_map(TAXONOMY)[clean_text(number)], by_link), lambda x: F.struct(x.alias("id"), F.when(x.isNotNull(), "STRUCTURED_FIELD").otherwise("NONE").alias("evidence")))


def category_by_words(*fields: Column) -> Column:
    """The first category whose words a field's labels have, one field after another."""

    def of(label: Column) -> Column:
        return let(fold(label), lambda t: F.coalesce(*[F.when(t.rlike(any_of(w)), x) for x, w in WORDS]))

    first = lambda f: F.get(F.filter(F.transform(v.json_list(f), of), lambda x: x.isNotNull()), F.lit(0))
    return F.coalesce(*map(first, fields))


def category_by_product(slug: Column, product: Column, subtype: Column) -> Column:
    known = _map(PRODUCTS)[F.lower(clean_text(slug))]
    exact = F.when((known == "apartment") & (fold(subtype) == "officetel"), "officetel").otherwise(known)
    said = category_by_words(product, subtype)
    return F.struct(F.coalesce(exact, said).alias("id"), F.when(exact.isNotNull(), "STRUCTURED_FIELD").when(said.isNotNull(), "SOURCE_LABEL").otherwise("NONE").alias("evidence"))


def category_by_labels(labels: Column) -> Column:
    """By the first rule that shares a label, else what the crawled page itself is about."""
    low = F.transform(v.json_list(labels), F.lower)
    said = F.coalesce(*[F.when(F.arrays_overlap(low, F.array(*map(F.lit, w))), x) for x, w in LABELS])
    return F.struct(F.coalesce(said, F.lit("house")).alias("id"), F.when(said.isNotNull(), "SOURCE_LABEL").otherwise("ENDPOINT_CONTEXT").alias("evidence"))


def address_part(rows: Column, *patterns: str) -> Column:
    """What the first pattern finds in the address with most parts that has any; ties in order. rows: array of addresses."""
    ordered = F.transform(F.array_sort(F.transform(rows, lambda a, i: F.struct((F.length(F.regexp_replace(a, ",", "")) - F.length(a)).alias("n"), i.alias("i"), a.alias("a")))), lambda x: x["a"])
    found = F.transform(ordered, lambda a: F.coalesce(*[v.part(a, p) for p in patterns]))
    return clean_text(F.regexp_replace(F.get(F.filter(found, lambda x: x.isNotNull()), F.lit(0)), r"(?iU)\s*\((?:mới|cũ)\)\s*$", ""))


def composed_address(address: Column, *more: Column) -> Column:
    """The address and whatever of more it does not name yet, joined by commas."""
    parts = F.filter(F.transform(F.split(F.coalesce(clean_text(address), F.lit("")), ","), lambda p: F.trim(p)), lambda p: p != "")
    for m in more:
        parts = let(F.struct(parts.alias("p"), clean_text(m).alias("m")), lambda x: F.when(x["m"].isNull() | F.exists(x["p"], lambda p: fold(p) == fold(x["m"])), x["p"]).otherwise(F.concat(x["p"], F.array(x["m"]))))
    return let(F.array_join(parts, ", "), lambda t: F.when(t != "", t))


def posted(text: Column, seen: Column) -> Column:
    """When it was posted: so long before the crawl, else a time not after it."""
    at = v.instant_at(text, ZONE)
    return F.when(seen.isNotNull(), F.coalesce(v.relative_time(text, seen), F.when(at <= seen, at)))


def canonical(df: DataFrame, columns: dict[str, Column], category: Column, unavailable: list[str] = ()) -> DataFrame:
    """The 27 canonical columns, in order, what follows from others filled in; evidence of the category, and reasons that don't count here."""
    first = {k: columns.get(k, F.lit(None)).cast(t) for k, t in CANONICAL.items()}
    out = df.select(*[x.alias(k) for k, x in first.items()], category.alias("category"), F.array(*map(F.lit, unavailable)).cast("array<string>").alias("unavailable"))
    c, point = F.col, v.has_point(F.col("lat"), F.col("lon"))
    out = out.withColumns({"category_id": c("category")["id"], "category_name": _map(NAMES)[c("category")["id"]], "evidence": c("category")["evidence"], "has_coord": point, "is_rent": F.lit(False), "source_id": v.business_key(c("source"), c("ad_id")), "price_m": c("price") / 1e6, "price_per_m2": F.when(c("area") > 0, c("price") / c("area"))})
    return out.withColumns({"lat": F.when(c("has_coord"), c("lat")), "lon": F.when(c("has_coord"), c("lon"))}).drop("category")


def from_cards(df: DataFrame) -> DataFrame:
    """Cards of a list page, fields as text, addresses and labels as JSON lists."""
    x = lambda n: _col(df, n)
    rows, link = v.json_list(x("location_rows")), v.normal_url(x("listing_url"))
    seen, category = v.instant_at(x("_scraped_at"), ZONE), category_by_labels(x("features"))
    cols = {
        "source": F.lower(F.coalesce(clean_text(x("_source")), F.lit("guland"))), "source_group": F.lit(CARD_GROUP), "ad_id": clean_text(x("listing_id")), "title": clean_text(x("title")), "price": v.price(x("price_text")),
        "price_str": clean_text(x("price_text")), "area": v.area_m2(x("area_text")), "rooms": F.coalesce(v.rooms(x("rooms")), v.rooms(x("description"))), "address": let(F.array_join(rows, " | "), lambda t: F.when(t != "", t)),
        "ward": address_part(rows, WARD), "district_name": address_part(rows, DISTRICT, CITY), "lat": x("lat").try_cast("double"), "lon": x("lon").try_cast("double"),
        "image": v.normal_url(x("image_url")), "ad_url": link, "source_url": F.coalesce(link, v.normal_url(x("_crawl_url"))), "posted_at": posted(x("posted_text"), seen), "scraped_at": seen, "page_fetched": v.positive_int(x("_source_page")),
    }
    return canonical(df, cols, category)


def from_products(df: DataFrame) -> DataFrame:
    """Products of an interface: numbers as text, structured places, times in milliseconds."""
    x = lambda n: _col(df, n)
    seen, category = v.instant_at(x("_scraped_at"), ZONE), category_by_product(x("product_slug"), x("product_name"), x("property_subtype"))
    public = F.when(x("public_date_ms").rlike(r"^\d{13}$"), v.timestamp(x("public_date_ms")))
    cols = {
        "source": F.lower(F.coalesce(clean_text(x("_source")), F.lit("nhadatvui"))), "source_group": v.first_known(x("product_slug"), x("product_name")), "ad_id": clean_text(x("listing_id")), "title": clean_text(x("title")), "price": v.price(x("price")),
        "price_str": clean_text(x("price")), "area": v.area_m2(x("area")), "rooms": v.rooms(x("rooms")), "address": composed_address(x("address"), x("ward_name"), x("province_name")), "ward": clean_text(x("ward_name")),
        "lat": x("lat").try_cast("double"), "lon": x("lng").try_cast("double"), "image": v.normal_url(x("first_image_url")), "source_url": v.normal_url(x("_crawl_url")),
        "posted_at": F.when(seen.isNull() | (public <= seen), public), "scraped_at": seen, "page_fetched": v.positive_int(x("_source_page")),
    }
    return canonical(df, cols, category)


def from_exports(df: DataFrame) -> DataFrame:
    """Exported lists whose columns vary; without any column for times or coordinates these aren't held against the rows."""
    x = lambda n: _col(df, n)
    link, seen = v.normal_url(x("listing_url")), v.instant_at(x("_scraped_at"), ZONE)
    address, category = clean_text(x("location_text")), category_by_number(x("category_id"), x("listing_url"))
    some = lambda names: v.first_known(*map(x, names))
    images = F.filter(F.transform(v.json_list(x("image_urls")), v.normal_url), lambda u: u.isNotNull())
    cols = {
        "source": F.lower(F.coalesce(clean_text(x("_source")), F.lit("batdongsan"))), "source_group": F.coalesce(some(("intent", "page_type", "product_type")), F.lit(EXPORT_GROUP)), "ad_id": clean_text(x("listing_id")), "title": clean_text(x("title")),
        "price": v.price(x("price_text")), "price_str": clean_text(x("price_text")), "area": v.area_m2(x("area_text")), "rooms": v.rooms(some(("bedrooms_text", "bedrooms_aria"))), "address": address, "ward": address_part(F.array(address), WARD),
        "district_name": address_part(F.array(address), DISTRICT, CITY), "lat": some(LATITUDE).try_cast("double"), "lon": some(LONGITUDE).try_cast("double"),
        "image": F.get(images, F.lit(0)), "ad_url": link, "source_url": F.coalesce(link, v.normal_url(x("_crawl_url"))), "posted_at": posted(some(POSTED), seen), "scraped_at": seen, "page_fetched": v.positive_int(some(("_source_page", "page_number_attr"))),
    }
    missing = [code for code, names in (("DQ08", POSTED), ("DQ09", LATITUDE + LONGITUDE)) if not set(names) & set(df.columns)]
    return canonical(df, cols, category, missing)


HASHED = [k for k in CANONICAL if k not in ("scraped_at", "page_fetched", "source_url")]
MEANT = ["title", "price", "area", "address", "category_id", "posted_at", "lat", "lon"]


def observations(df: DataFrame, batch_id: str) -> DataFrame:
    """The canonical columns of from_* with repaired values, batch, quality status and reasons, record hash, completeness and evidence."""
    c = F.col
    out = df.withColumn("fixed", v.plausible(c("price"), c("price_str"), c("area"), c("title"), c("is_rent")))
    out = out.withColumns({"price": c("fixed")["price"], "area": c("fixed")["area"], "repaired": c("fixed")["reasons"]}).drop("fixed")
    out = out.withColumns({"price_m": c("price") / 1e6, "price_per_m2": F.when(c("area") > 0, c("price") / c("area"))})
    reject = ((c("source").isNull(), "DQ01"), (c("ad_id").isNull(), "DQ02"), (c("title").isNull(), "DQ03"))
    warn = ((c("price").isNull(), "DQ04"), (c("area").isNull(), "DQ05"), (c("is_rent").isNull(), "DQ06"), (c("category_id").isNull(), "DQ07"), (c("posted_at").isNull(), "DQ08"), (~c("has_coord"), "DQ09"))
    held = F.filter(F.array(*[F.when(x, F.lit(n)) for x, n in (*reject, *warn)]), lambda r: r.isNotNull())
    late = F.when(c("snapshot_date").isNull(), F.array(F.lit("DQ13"))).otherwise(F.array().cast("array<string>"))
    out = out.withColumns({"batch_id": F.lit(batch_id), "snapshot_date": v.batch_date(F.lit(batch_id))})
    out = out.withColumn("dq_reasons", F.concat(F.array_except(F.array_union(held, c("repaired")), c("unavailable")), late))
    status = F.when(F.arrays_overlap("dq_reasons", F.array(*map(F.lit, ("DQ01", "DQ02", "DQ03", "DQ13")))), "REJECT").when(F.size("dq_reasons") > 0, "WARN").otherwise("PASS")
    evidence = F.when(c("category_name").isNotNull(), c("evidence")).otherwise("NONE")
    return out.select(*CANONICAL, "batch_id", "snapshot_date", "dq_reasons", status.alias("dq_status"), evidence.alias("category_evidence"), v.canonical_hash(*HASHED).alias("record_hash"), v.completeness(*MEANT).alias("completeness_score"))


def report(df: DataFrame) -> DataFrame:
    """(what, n): how many observations have each status, reason and category."""
    what = F.concat(F.array(F.concat(F.lit("status "), F.col("dq_status"))), F.transform("dq_reasons", lambda r: F.concat(F.lit("reason "), r)), F.when(F.col("category_id").isNotNull(), F.array(F.concat(F.lit("category "), F.col("category_id")))).otherwise(F.array().cast("array<string>")))
    return df.select(F.explode(what).alias("what")).groupBy("what").agg(F.count("*").alias("n"))


def flags(df: DataFrame) -> DataFrame:
    """df with price_known, area_known, rooms_known, location_known, legal_known, and score, their share. df is located."""
    c = F.col
    known = {"price_known": c("price") > 0, "area_known": c("area") > 0, "rooms_known": c("rooms") > 0, "location_known": c("has_coord") | c("province").isNotNull() | c("district").isNotNull(), "legal_known": feature_status("legal", c("title")).isNotNull()}
    out = df.withColumns({k: F.coalesce(x, F.lit(False)) for k, x in known.items()})
    return out.withColumn("score", F.round(sum(c(k).cast("int") for k in known) / F.lit(float(len(known))), 6))
