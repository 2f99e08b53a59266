"""Open-contracting releases: nested JSON lines to flat tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

VALUE = "value: struct<amount: double, amountNet: double, currency: string>"
PERIOD = "startDate: string, endDate: string"
DOCS = "array<struct<id: string, documentType: string, title: string, description: string, url: string, format: string, datePublished: string>>"
#: What is read of a release; other members are ignored, missing ones are null.
RELEASE = f"""
ocid string, id string, date string, tag array<string>, description string, buyer struct<id: string, name: string>,
parties array<struct<id: string, name: string, roles: array<string>, identifier: struct<scheme: string, id: string, legalName: string>,
  address: struct<region: string, postalCode: string>, details: struct<url: string, classifications: array<struct<scheme: string, id: string>>>>>,
tender struct<id: string, title: string, description: string, status: string, {VALUE}, procurementMethod: string, mainProcurementCategory: string,
  classification: struct<id: string, scheme: string, description: string>, tenderPeriod: struct<{PERIOD}>, contractPeriod: struct<{PERIOD}>, documents: {DOCS},
  lots: array<struct<id: string, title: string, description: string, status: string, hasOptions: boolean, hasRenewal: boolean, {VALUE}, contractPeriod: struct<{PERIOD}>,
    awardCriteria: struct<criteria: array<struct<type: string, name: string, description: string>>>>>,
  items: array<struct<id: string, relatedLot: string, classification: struct<id: string, description: string>>>>,
awards array<struct<id: string, title: string, description: string, status: string, {VALUE}, suppliers: array<struct<id: string, name: string>>, relatedLots: array<string>, contractPeriod: struct<{PERIOD}>, documents: {DOCS}>>,
contracts array<struct<id: string, awardID: string, {VALUE}, dateSigned: string, period: struct<{PERIOD}>, status: string, documents: {DOCS}>>,
bids struct<statistics: array<struct<id: string, measure: string, value: double, relatedLot: string>>>
""".replace("\n", " ")


def _none(column: str) -> Column:
    """An empty list of the type of a column of RELEASE."""
    return F.array().cast(T.StructType.fromDDL(RELEASE)[column].dataType)


def read_releases(spark: SparkSession, path: str | list[str], years: list[int] | None = None) -> DataFrame:
    """Releases of JSON-lines files (gzip too): blank and malformed lines, and releases without ocid or date, are left out.

    `years` keeps the files whose name holds one of the years, so others are not read. Columns: RELEASE, source_file, line_hash.
    """
    schema = T.StructType.fromDDL(RELEASE).add("_bad", T.StringType())
    raw = spark.read.schema(schema).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").json(path)
    name = F.regexp_extract(F.col("_metadata.file_name"), r"^([^.]+)", 1)
    raw = raw.withColumn("source_file", name)
    if years:
        raw = raw.where(reduce(lambda a, b: a | b, (F.col("_metadata.file_name").contains(str(y)) for y in years)))
    return raw.where(F.col("_bad").isNull() & (F.trim("ocid") != "") & (F.trim("date") != "")).drop("_bad")


def parse_lines(lines: DataFrame, value: str = "value", file: str = "source_file") -> DataFrame:
    """Releases of a column of JSON texts, by the rules of `read_releases`: blank and malformed ones, and those without ocid or date, are left out."""
    schema = T.StructType.fromDDL(RELEASE).add("_bad", T.StringType())
    parsed = F.from_json(value, schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    # As a generator's output a text is parsed once; as a column the filter below would be pushed under it and parse it again for each condition.
    r = lines.where(F.trim(value) != "").select(F.explode(F.array(parsed)).alias("r"), F.col(file).alias("source_file")).select("r.*", "source_file")
    return r.where(F.col("_bad").isNull() & (F.trim("ocid") != "") & (F.trim("date") != "")).drop("_bad")


def aligned_snapshot(releases: DataFrame, chosen: DataFrame) -> DataFrame:
    """The raw releases that were chosen (`ocid, id`), one per process: of several copies the first by file."""
    rest = [c for c in releases.columns if c not in ("ocid", "id")]
    d = releases.join(chosen.select("ocid", "id"), ["ocid", "id"], "left_semi")
    return d.groupBy("ocid").agg(F.min_by(F.struct("id", *rest), F.struct("source_file", "date")).alias("r")).select("ocid", "r.*")


def _descending(text: Column) -> Column:
    """A text that sorts as `text` does, but backwards: its bytes' complements, and an end that comes after all of them."""
    return F.concat(F.translate(F.hex(text), "0123456789ABCDEF", "FEDCBA9876543210"), F.lit("G"))


def latest_releases(releases: DataFrame) -> DataFrame:
    """One release per ocid, of the greatest date (ties: the first file, then the smaller id), with `source_years`, the files it stood in.

    One aggregation with one shuffle; a process with many releases combines before it. All columns of `releases` besides ocid, id, date and
    source_file are carried along, so select those that are asked for first: inside the aggregate nothing is pruned.
    """
    rest = [c for c in releases.columns if c != "ocid"]
    first = F.struct(_descending(F.col("date")), "source_file", "id")
    g = releases.groupBy("ocid").agg(F.min_by(F.struct(*rest), first).alias("r"), F.array_join(F.array_sort(F.collect_set("source_file")), "|").alias("source_years"))
    return g.select("ocid", "r.*", "source_years").withColumn("year", F.expr("try_cast(substring(date, 1, 4) as int)"))


def blank(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def best_amount(v: Column) -> Column:
    """The amount, else the net amount; an amount of zero is an amount."""
    return F.coalesce(v["amount"], v["amountNet"])


def tender_core(r: DataFrame) -> DataFrame:
    """One row per process."""
    t = F.col("tender")
    return r.select(
        "ocid", "date", "year", blank(F.col("buyer.id")).alias("buyer_raw_id"), blank(F.col("buyer.name")).alias("buyer_name"), blank(t["title"]).alias("tender_title"), blank(t["status"]).alias("tender_status"),
        best_amount(t["value"]).alias("tender_value_amount"), blank(t["value"]["currency"]).alias("tender_value_currency"), blank(t["classification"]["id"]).alias("tender_cpv_id"),
        blank(t["classification"]["description"]).alias("tender_cpv_description"), blank(t["procurementMethod"]).alias("tender_method"), blank(t["mainProcurementCategory"]).alias("tender_category"),
        blank(t["tenderPeriod"]["endDate"]).alias("tender_period_end"), blank(t["contractPeriod"]["startDate"]).alias("contract_period_start"), blank(t["contractPeriod"]["endDate"]).alias("contract_period_end"),
        F.size(F.coalesce(t["lots"], F.array())).alias("n_lots"), "source_years",
    )


def lots(r: DataFrame) -> DataFrame:
    """ocid × lot."""
    d = r.select("ocid", F.posexplode("tender.lots").alias("lot_no", "l"), F.col("tender.items").alias("items"))
    own = F.filter(F.coalesce("items", F.array()), lambda i: i["relatedLot"] == F.col("l.id"))
    return d.select(
        "ocid", blank(F.col("l.id")).alias("lot_id"), "lot_no", blank(F.col("l.title")).alias("lot_title"), blank(F.col("l.description")).alias("lot_description"), blank(F.col("l.status")).alias("lot_status"),
        best_amount(F.col("l.value")).alias("lot_value_amount"), F.col("l.hasOptions").alias("has_options"), F.col("l.hasRenewal").alias("has_renewal"),
        blank(F.col("l.contractPeriod.startDate")).alias("lot_start"), blank(F.col("l.contractPeriod.endDate")).alias("lot_end"), F.size(own).alias("n_items"),
        F.array_join(F.array_sort(F.array_distinct(F.transform(own, lambda i: blank(i["classification"]["id"])))), "|").alias("item_codes"),
    )


def award_criteria(r: DataFrame) -> DataFrame:
    """ocid × lot × criterion."""
    l = r.select("ocid", F.explode("tender.lots").alias("l"))
    d = l.select("ocid", blank(F.col("l.id")).alias("lot_id"), F.posexplode("l.awardCriteria.criteria").alias("idx", "c"))
    return d.select("ocid", "lot_id", "idx", blank(F.col("c.type")).alias("criterion_type"), blank(F.col("c.name")).alias("criterion_name"), blank(F.col("c.description")).alias("criterion_description"))


def contracts_by_award(r: DataFrame) -> DataFrame:
    """Per award: the first contract's id, amount and dates (smallest contract id first) and their number."""
    c = r.select("ocid", F.explode("contracts").alias("c")).where(F.trim("c.awardID") != "")
    first = lambda e: F.min_by(e, F.when(e.isNotNull(), F.col("c.id")))
    return c.groupBy("ocid", F.col("c.awardID").alias("award_id")).agg(
        F.min("c.id").alias("contract_id"), first(best_amount(F.col("c.value"))).alias("contract_value"), first(F.col("c.dateSigned")).alias("date_signed"), F.count_distinct("c.id").alias("n_contracts")
    )


def award_list() -> Column:
    """The awards of a release, with the best value and where it comes from: award, else contract, else tender. Its contracts are looked up in the release."""
    none = F.array().cast("array<string>")
    known = F.filter("contracts", lambda c: F.trim(c["awardID"]) != "")
    tender_value = best_amount(F.col("tender.value"))

    def first(own: Column, e) -> Column:
        """The value of the smallest contract id that has one."""
        some = F.filter(own, lambda c: e(c).isNotNull() & c["id"].isNotNull())
        return F.get(F.array_sort(F.transform(some, lambda c: F.struct(c["id"].alias("id"), e(c).alias("e")))), F.lit(0))["e"]

    def row(a: Column, own: Column) -> Column:
        value, contract_value = best_amount(a["value"]), first(own, lambda c: best_amount(c["value"]))
        source = F.when(value.isNotNull(), "award").when(contract_value.isNotNull(), "contract").when(tender_value.isNotNull(), "tender").otherwise("")
        return F.struct(
            blank(a["id"]).alias("award_id"), blank(F.array_min(F.transform(own, lambda c: c["id"]))).alias("contract_id"), blank(a["title"]).alias("award_title"), blank(a["status"]).alias("award_status"),
            value.alias("award_value_amount"), F.coalesce(value, contract_value, tender_value).alias("award_value_best_amount"), source.alias("award_value_source"), blank(a["value"]["currency"]).alias("award_value_currency"),
            blank(first(own, lambda c: c["dateSigned"])).alias("award_date_signed"), blank(a["contractPeriod"]["startDate"]).alias("award_period_start"), blank(a["contractPeriod"]["endDate"]).alias("award_period_end"),
            F.coalesce(a["relatedLots"], none).alias("related_lots"), F.coalesce(F.transform(a["suppliers"], lambda s: s["id"]), none).alias("supplier_raw_ids"),
            F.size(F.array_distinct(F.array_compact(F.transform(own, lambda c: c["id"])))).cast("long").alias("n_contracts"),
        )

    def with_own(a: Column) -> Column:
        own = F.coalesce(F.filter(known, lambda c: c["awardID"] == blank(a["id"])), _none("contracts"))
        return F.transform(F.array(own), lambda o: row(a, o))[0]

    return F.transform("awards", with_own)


def awards(r: DataFrame) -> DataFrame:
    """ocid × award (`award_list`) of the latest releases, one row an ocid: nothing is shuffled."""
    return r.select("ocid", F.inline(award_list()))


def bid_stats(r: DataFrame) -> DataFrame:
    """ocid × statistic."""
    return r.select("ocid", F.inline("bids.statistics")).select("ocid", "measure", "value", blank(F.col("relatedLot")).alias("lot_id"))


def text_evidence(r: DataFrame) -> DataFrame:
    """ocid × field × lot: every non-blank text that may support an answer."""
    none = F.lit("")
    parts = [
        r.select("ocid", F.lit("tender.title").alias("field_path"), none.alias("lot_id"), F.col("tender.title").alias("text")),
        r.select("ocid", F.lit("tender.description"), none, F.col("tender.description")),
        r.select("ocid", F.explode("tender.lots").alias("l")).select("ocid", F.lit("tender.lots[].title"), blank(F.col("l.id")), F.col("l.title")),
        r.select("ocid", F.explode("tender.lots").alias("l")).select("ocid", F.lit("tender.lots[].description"), blank(F.col("l.id")), F.col("l.description")),
        r.select("ocid", F.explode("awards").alias("a")).select("ocid", F.lit("awards[].description"), F.coalesce(F.get("a.relatedLots", F.lit(0)), none), F.col("a.description")),
        award_criteria(r).select("ocid", F.lit("tender.lots[].awardCriteria"), "lot_id", F.concat_ws(": ", F.nullif("criterion_name", none), F.nullif("criterion_description", none))),
    ]
    return reduce(DataFrame.unionAll, parts).where(F.trim("text") != "")


def documents(r: DataFrame) -> DataFrame:
    """ocid × document of tender, awards and contracts."""
    sides = [("tender", F.col("tender.documents")), ("award", F.flatten(F.transform("awards", lambda a: F.coalesce(a["documents"], F.array().cast(DOCS))))), ("contract", F.flatten(F.transform("contracts", lambda c: F.coalesce(c["documents"], F.array().cast(DOCS)))))]
    out = [r.select("ocid", F.lit(s).alias("source"), F.explode(c).alias("d")) for s, c in sides]
    return reduce(DataFrame.unionAll, out).select(
        "ocid", "source", *[blank(F.col(f"d.{a}")).alias(b) for a, b in (("id", "document_id"), ("documentType", "document_type"), ("title", "title"), ("description", "description"), ("url", "url"), ("format", "format"), ("datePublished", "date_published"))]
    ).where("url <> '' or document_id <> ''")


def party_list() -> Column:
    """The parties of a release, and the suppliers that only its awards name; those without id are left out."""
    none = F.lit("")
    named = F.transform(
        F.coalesce("parties", _none("parties")),
        lambda p: F.struct(
            blank(p["id"]).alias("raw_id"), blank(p["name"]).alias("name"), F.coalesce(p["roles"], F.array().cast("array<string>")).alias("roles"),
            blank(p["identifier"]["scheme"]).alias("identifier_scheme"), blank(p["identifier"]["id"]).alias("identifier_id"), blank(p["identifier"]["legalName"]).alias("identifier_legal_name"),
            blank(p["address"]["region"]).alias("address_region"), blank(p["address"]["postalCode"]).alias("postal_code"), blank(p["details"]["url"]).alias("details_url"),
        ),
    )
    suppliers = F.flatten(F.transform(F.coalesce("awards", _none("awards")), lambda a: F.coalesce(a["suppliers"], F.array().cast("array<struct<id: string, name: string>>"))))
    pairs = F.array_distinct(F.transform(suppliers, lambda s: F.struct(blank(s["id"]).alias("id"), blank(s["name"]).alias("name"))))
    rest = F.transform(
        F.filter(pairs, lambda s: ~F.array_contains(F.transform("parties", lambda p: blank(p["id"])), s["id"]) | F.col("parties").isNull()),
        lambda s: F.struct(s["id"].alias("raw_id"), s["name"].alias("name"), F.array(F.lit("supplier")).alias("roles"), *[none.alias(c) for c in ("identifier_scheme", "identifier_id", "identifier_legal_name", "address_region", "postal_code", "details_url")]),
    )
    return F.filter(F.concat(named, rest), lambda p: p["raw_id"] != "")


def party_observations(r: DataFrame) -> DataFrame:
    """ocid × party, and suppliers that only awards name (`party_list`), of the latest releases: nothing is shuffled."""
    return r.select("ocid", "year", F.inline(party_list()))


TABLES = {"tender_core": tender_core, "lots": lots, "award_criteria": award_criteria, "awards": awards, "bid_stats": bid_stats, "text_evidence": text_evidence, "documents": documents, "party_observations": party_observations}


def extract(r: DataFrame) -> dict[str, DataFrame]:
    """All flat tables of the latest releases."""
    return {name: f(r) for name, f in TABLES.items()}
