"""Boards: how each one's landed payload becomes raw postings.

A board is a schema of one item and a mapper, from the fields of an item to what keeps it and the columns of its raw
posting; ``MAPPERS`` holds them and takes more through ``register``. JSON text is read with the schema; a text that is no
such JSON, or says ok: false, is a failed page. A missing id is null. ``read_boards`` maps the payloads of all boards in one
pass over what landed, each row by its own board; ``read_items`` and ``map_items`` do the same for one board.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.functions import dates, pay, text, urls
from tideline.operators.identity import to_posting

Item = Callable[[str], Column]  #: from a field's name, dotted where nested, to its value
Mapped = tuple[Column | None, dict[str, Column]]  #: what keeps an item (None: always), and the raw posting's columns
Mapper = Callable[[Item, Column], Mapped]
#: Columns that mappers may give; ``escaped`` is a description that has its entities yet.
RAW = (
    "source STRING, source_native_id STRING, title STRING, company STRING, location STRING, is_remote BOOLEAN, url STRING, description STRING, escaped STRING, "
    "salary_min BIGINT, salary_max BIGINT, salary_currency STRING, salary_period STRING, posted_at TIMESTAMP"
)


@dataclass(frozen=True)
class Board:
    name: str
    item: str  #: DDL of one item
    root: str  #: where items stand in the payload: '' for a bare array
    mapper: Mapper
    ord: int  #: input order of sources; the tabular scrape first, company boards last
    by_company: bool = False
    page_limit: int | None = None  #: fewer items than this are all there are


MAPPERS: dict[str, Board] = {}


def register(board: Board) -> None:
    MAPPERS[board.name] = board


NEEDS_KEY = ("adzuna", "jooble")


def catalogues(settings: DataFrame, boards: dict[str, Board] | None = None) -> DataFrame:
    """Each feed's sources in input order: feed, source, ord, enabled.

    ``settings`` is (feed, enabled, keys, companies): arrays of board names that are on and that have a key, and a map from board to
    its companies. A board that needs a key is enabled with one only, a board of companies with some only.
    """
    known = [(b.name, b.ord, b.name in NEEDS_KEY, b.by_company) for b in (MAPPERS if boards is None else boards).values()]
    rows = F.array(*[F.struct(F.lit(n).alias("source"), F.lit(o).alias("ord"), F.lit(k).alias("needs_key"), F.lit(c).alias("by_company")) for n, o, k, c in known])
    has = lambda names: F.coalesce(F.array_contains(names, F.col("source")), F.lit(False))
    some = F.coalesce(F.size(F.try_element_at("companies", F.col("source"))) > 0, F.lit(False))
    on = has(F.col("enabled")) & (~F.col("needs_key") | has(F.col("keys"))) & (~F.col("by_company") | some)
    return settings.select("feed", "enabled", "keys", "companies", F.inline(rows)).select("feed", "source", "ord", on.alias("enabled"))


def catalogue(spark, enabled: set[str], keys: set[str] = frozenset(), companies: dict[str, list[str]] | None = None) -> DataFrame:
    """(source, ord, enabled) of one feed, by input order."""
    one = spark.createDataFrame([("", sorted(enabled), sorted(keys), companies or {})], "feed string, enabled array<string>, keys array<string>, companies map<string,array<string>>")
    return catalogues(one).drop("feed").orderBy("ord")


def _listed(board: Board, payload: Column) -> Column:
    """The items of a payload, or null where it is none."""
    listed = f"array<struct<{board.item}>>"
    names = board.root.split(".") if board.root else []
    schema = listed
    for name in reversed(names):
        schema = f"struct<{name}:{schema}>"
    items = F.from_json(payload, schema)
    for name in names:
        items = items[name]
    refused = payload.contains('"ok"') & F.coalesce(F.get_json_object(payload, "$.ok") == "false", F.lit(False))
    return F.when(~refused if names else ~refused & F.trim(payload).startswith("["), items)


def _page(rows: DataFrame, items: str, exhaustive: Column | None) -> DataFrame:
    pages = rows.withColumns({"n_items": F.coalesce(F.size(items), F.lit(0)), "ok": F.col(items).isNotNull()})
    return (pages if exhaustive is None else pages.withColumn("exhaustive", exhaustive)).drop(items, "payload")


def read_items(payloads: DataFrame, board: Board) -> tuple[DataFrame, DataFrame]:
    """(items, pages) of (payload, company, ...): items as column ``item`` with ``pos``, pages with n_items, ok, exhaustive."""
    rows = payloads.withColumn("_items", F.when(F.col("payload").isNotNull(), _listed(board, F.col("payload"))))
    found = rows.select("*", F.posexplode_outer("_items").alias("pos", "item")).where(F.col("item").isNotNull())
    return found.drop("_items", "payload"), _page(rows, "_items", F.col("n_items") < board.page_limit if board.page_limit else None)


def _described(raw: DataFrame) -> DataFrame:
    """Descriptions with their entities unescaped; the others do not go through Python."""
    from tideline.operators.pages import unescape_html

    return raw.withColumn("description", F.coalesce(unescape_html(F.col("escaped")), "description")).drop("escaped")


def map_items(items: DataFrame, board: Board, as_of: Column) -> DataFrame:
    """Postings of a board's items; ``source`` names the company where the board is one of companies."""
    keep, columns = board.mapper(lambda name: F.col(f"item.{name}"), as_of)
    rows = items if keep is None else items.where(keep)
    carried = [c for c in ("pos", "company_key", "cycle") if c in items.columns]
    return to_posting(_described(rows.select(*_columns(columns), *carried)))


def _columns(given: dict[str, Column]) -> list[Column]:
    return [given.get(n, F.lit(None)).cast(t).alias(n) for n, t in (c.split() for c in RAW.split(", "))]


def _fields(item: Column) -> Item:
    def of(name: str) -> Column:
        value = item
        for part in name.split("."):
            value = value[part]
        return value

    return of


def read_boards(landed: DataFrame, as_of: Column, boards: dict[str, Board] | None = None) -> tuple[DataFrame, DataFrame]:
    """(postings, pages) of (board, payload, company_key, ...), whatever boards they are of.

    A row's payload is read with its own board's schema only, its items become raw postings as they are read, and one
    explode gives them as rows; so what landed is scanned once. Rows of unknown boards are failed pages.
    """

    def posting_of(board: Board) -> Callable[[Column, Column], Column]:
        def posting(item: Column, pos: Column) -> Column:
            keep, columns = board.mapper(_fields(item), as_of)
            kept = item.isNotNull() if keep is None else item.isNotNull() & F.coalesce(keep, F.lit(False))
            return F.struct(*_columns(columns), kept.alias("kept"), pos.alias("pos"))

        return posting

    found, limit = F, F
    for board in (MAPPERS if boards is None else boards).values():
        mine = F.col("board") == board.name
        found = found.when(mine, F.transform(_listed(board, F.col("payload")), posting_of(board)))
        limit = limit.when(mine, F.lit(board.page_limit).cast("int"))
    rows = landed.withColumn("_found", F.when(F.col("payload").isNotNull(), found))
    others = [c for c in landed.columns if c != "payload"]
    # the outer form: from a plain explode Spark infers a filter on its array, which reads and maps every payload again
    each = rows.select(*others, F.explode_outer("_found").alias("_p")).where("_p.kept").select(*others, "_p.*").drop("kept")
    return to_posting(_described(each)), _page(rows, "_found", F.coalesce(F.col("n_items") < limit, F.lit(False)))


def _filled(c: Column) -> Column:
    return F.nullif(c.cast("string"), F.lit(""))


def _remoteok(i: Item, as_of: Column) -> Mapped:
    keep = (_filled(i("id")).isNotNull() & _filled(i("position")).isNotNull())
    return keep, dict(
        source=F.lit("remoteok"), source_native_id=i("id").cast("string"), title=i("position"), company=F.coalesce(i("company"), F.lit("")), url=F.coalesce(i("url"), F.lit("")),
        location=F.coalesce(_filled(i("location")), F.lit("Remote")), is_remote=F.lit(True), description=i("description"), salary_min=pay.positive_int(i("salary_min")),
        salary_max=pay.positive_int(i("salary_max")), salary_currency=F.lit("USD"), posted_at=F.coalesce(dates.iso(i("date")), dates.epoch_seconds(i("epoch"))),
    )


def _himalayas(i: Item, as_of: Column) -> Mapped:
    first = F.try_element_at(i("locationRestrictions"), F.lit(1))
    return None, dict(
        source=F.lit("himalayas"), source_native_id=i("guid"), title=F.coalesce(i("title"), F.lit("")), company=F.coalesce(i("companyName"), F.lit("")), url=F.coalesce(i("applicationLink"), F.lit("")),
        location=F.when(F.size(i("locationRestrictions")) > 0, first).otherwise(F.lit("Remote")), is_remote=F.lit(True), description=F.coalesce(_filled(i("description")), _filled(i("excerpt"))),
        salary_min=pay.positive_int(i("minSalary")), salary_max=pay.positive_int(i("maxSalary")), salary_currency=i("currency"),
        salary_period=pay.looked_up(pay.PERIOD_WORDS["board"], i("salaryPeriod")), posted_at=dates.epoch_seconds(i("pubDate")),
    )


def jobicy_mapper(job_type: str | None = None) -> Mapper:
    def jobicy(i: Item, as_of: Column) -> Mapped:
        keep = F.coalesce(F.exists(i("jobType"), lambda t: F.lower(t).contains(job_type.lower())), F.lit(False)) if job_type else None
        return keep, dict(
            source=F.lit("jobicy"), source_native_id=i("id").cast("string"), title=F.coalesce(i("jobTitle"), F.lit("")), company=F.coalesce(i("companyName"), F.lit("")), url=F.coalesce(i("url"), F.lit("")),
            location=F.coalesce(_filled(i("jobGeo")), F.lit("Remote")), is_remote=F.lit(True), description=i("jobDescription"), salary_min=pay.positive_int(i("salaryMin")),
            salary_max=pay.positive_int(i("salaryMax")), salary_currency=i("salaryCurrency"), salary_period=pay.looked_up(pay.PERIOD_WORDS["board"], i("salaryPeriod")), posted_at=dates.iso(i("pubDate")),
        )

    return jobicy


def adzuna_mapper(country: str = "in") -> Mapper:
    def adzuna(i: Item, as_of: Column) -> Mapped:
        return None, dict(
            source=F.lit("adzuna"), source_native_id=i("id"), title=F.coalesce(i("title"), F.lit("")), company=F.coalesce(i("company.display_name"), F.lit("")), url=F.coalesce(i("redirect_url"), F.lit("")),
            location=i("location.display_name"), is_remote=F.lit(None).cast("boolean"), description=i("description"), salary_min=pay.positive_int(i("salary_min")),
            salary_max=pay.positive_int(i("salary_max")), salary_currency=F.lit(pay.COUNTRY_CURRENCIES.get(country.lower())), salary_period=F.lit("year"), posted_at=dates.iso(i("created")),
        )

    return adzuna


def _jooble(i: Item, as_of: Column) -> Mapped:
    return None, dict(
        source=F.lit("jooble"), source_native_id=i("id"), title=F.coalesce(i("title"), F.lit("")), company=F.coalesce(i("company"), F.lit("")), url=F.coalesce(i("link"), F.lit("")),
        location=i("location"), is_remote=F.lit(None).cast("boolean"), description=i("snippet"), posted_at=dates.iso(i("updated")),
    )


def unstop_mapper(max_age_days: int = 35) -> Mapper:
    def unstop(i: Item, as_of: Column) -> Mapped:
        posted = F.coalesce(dates.iso(i("updated_at")), dates.iso(i("start_date")))
        fresh = posted.isNull() | (posted >= as_of - F.make_dt_interval(F.lit(max_age_days)))
        keep = (fresh & ~i("regnRequirements.reg_status").eqNullSafe("FINISHED"))
        shown = F.coalesce((i("jobDetail.show_salary") == 1) & ~F.coalesce(i("jobDetail.not_disclosed"), F.lit(False)), F.lit(False))
        region = F.trim(F.coalesce(i("region"), F.lit("")))
        online = F.lower(region) == "online"
        return keep, dict(
            source=F.lit("unstop"), source_native_id=i("id").cast("string"), title=F.coalesce(i("title"), F.lit("")), company=F.coalesce(_filled(i("organisation.name")), F.lit("")),
            url=urls.opportunity_url(i("seo_url"), i("public_url"), i("short_url")), location=F.when(~online, _filled(region)), is_remote=F.when(online, True),
            description=text.opportunity_description(i("details"), i("required_skills"), i("workfunction.name")), salary_min=F.when(shown, pay.positive_int(i("jobDetail.min_salary"))),
            salary_max=F.when(shown, pay.positive_int(i("jobDetail.max_salary"))), salary_currency=F.when(shown, pay.looked_up(pay.CURRENCY_ICONS, i("jobDetail.currency"))),
            salary_period=F.when(shown, pay.looked_up(pay.PERIOD_WORDS["unstop"], i("jobDetail.pay_in"))), posted_at=posted,
        )

    return unstop


def _internshala(i: Item, as_of: Column) -> Mapped:
    title, company, href = (F.trim(F.coalesce(i(c), F.lit(""))) for c in ("title", "company", "href"))
    keep = ((title != "") & (company != "") & (href != ""))
    location = F.trim(F.coalesce(i("location"), F.lit("")))
    home = F.lower(location) == "work from home"
    amount = pay.stipend(i("stipend"))
    slug = F.replace(F.coalesce(i("slug"), F.lit("")), F.lit("-"), F.lit(" "))
    paid = amount["low"].isNotNull()
    return keep, dict(
        source=F.lit("internshala"), source_native_id=_filled(i("id")), title=F.when(F.lower(title).contains("intern"), title).otherwise(F.concat(title, F.lit(" Internship"))), company=company,
        url=F.when(href.startswith("/"), F.concat(F.lit("https://internshala.com"), href)).otherwise(href), location=F.when(~home, _filled(location)), is_remote=F.when(home, True),
        description=F.when(slug != "", F.concat(F.lit("Internshala listing: "), slug, F.lit("."))), salary_min=amount["low"], salary_max=amount["high"], salary_currency=F.when(paid, "INR"),
        salary_period=F.when(paid, "month"), posted_at=dates.posted_ago(i("ago"), as_of),
    )


def _company(board: str) -> Column:
    return F.concat(F.lit(f"{board}_"), F.col("company_key"))


def _greenhouse(i: Item, as_of: Column) -> Mapped:
    location = F.coalesce(i("location.name"), F.lit(""))
    return None, dict(
        source=_company("greenhouse"), source_native_id=i("id").cast("string"), title=F.coalesce(i("title"), F.lit("")), company=F.coalesce(_filled(i("company_name")), F.col("company_key")),
        url=F.coalesce(i("absolute_url"), F.lit("")), location=_filled(location), is_remote=F.when(F.lower(location).contains("remote"), True), escaped=_filled(i("content")),
        posted_at=F.coalesce(dates.iso(i("updated_at")), dates.iso(i("first_published"))),
    )


def _lever(i: Item, as_of: Column) -> Mapped:
    place = F.lower(i("workplaceType"))
    return None, dict(
        source=_company("lever"), source_native_id=i("id"), title=F.coalesce(i("text"), F.lit("")), company=F.col("company_key"), url=F.coalesce(i("hostedUrl"), F.lit("")), location=i("categories.location"),
        is_remote=F.when(place == "remote", True).when(place.isin("onsite", "hybrid"), False), description=i("description"), salary_min=pay.positive_int(i("salaryRange.min")),
        salary_max=pay.positive_int(i("salaryRange.max")), salary_currency=i("salaryRange.currency"), salary_period=pay.looked_up(pay.PERIOD_WORDS["lever"], i("salaryRange.interval")), posted_at=dates.epoch_millis(i("createdAt")),
    )


def _ashby(i: Item, as_of: Column) -> Mapped:
    part = F.try_element_at(F.filter(i("compensation.summaryComponents"), lambda c: c["compensationType"] == "Salary"), F.lit(1))
    return F.coalesce(i("isListed"), F.lit(True)), dict(
        source=_company("ashby"), source_native_id=i("id"), title=F.coalesce(i("title"), F.lit("")), company=F.coalesce(_filled(i("organizationName")), F.col("company_key")),
        url=F.coalesce(_filled(i("jobUrl")), _filled(i("applyUrl")), F.lit("")), location=i("location"), is_remote=F.coalesce(i("isRemote"), F.lit(False)), description=i("descriptionHtml"),
        salary_min=pay.positive_int(part["minValue"]), salary_max=pay.positive_int(part["maxValue"]), salary_currency=part["currencyCode"], salary_period=pay.interval_period(part["interval"]), posted_at=dates.iso(i("publishedAt")),
    )


def _smartrecruiters(i: Item, as_of: Column) -> Mapped:
    parts = [_filled(i(f"location.{c}")) for c in ("city", "region", "country")]
    return None, dict(
        source=_company("smartrecruiters"), source_native_id=i("id"), title=F.coalesce(i("name"), F.lit("")), company=F.coalesce(_filled(i("company.name")), F.col("company_key")), url=F.coalesce(i("ref"), F.lit("")),
        location=F.nullif(F.concat_ws(", ", *parts), F.lit("")), is_remote=F.coalesce(i("location.remote"), F.lit(False)), posted_at=dates.iso(i("releasedDate")),
    )


def map_scrape(frame: DataFrame, rates: dict[str, float]) -> DataFrame:
    """Postings of a scraped frame with site; required title, company and URL; pay is converted here, amounts rounded first."""
    title, company, url = (pay.clean_string(F.col(c)) for c in ("title", "company", "job_url"))
    low, high = pay.clean_float(F.col("min_amount")), pay.clean_float(F.col("max_amount"))
    currency, interval = F.upper(pay.clean_string(F.col("currency"))), pay.clean_string(F.col("interval"))
    period = pay.looked_up(pay.PERIOD_WORDS["scrape"], interval)
    known = period.isNotNull() & pay.rates_of(rates)[currency].isNotNull() & F.coalesce(low, high).isNotNull()
    rows = frame.where(title.isNotNull() & company.isNotNull() & url.isNotNull())
    amount = lambda v: F.when(known, pay.to_month(F.rint(v), currency, period, rates))
    raw = rows.select(
        F.concat(F.lit("jobspy_"), F.col("site")).alias("source"), title.alias("title"), company.alias("company"), pay.clean_string(F.col("location")).alias("location"), pay.clean_bool(F.col("is_remote")).alias("is_remote"),
        url.alias("url"), pay.clean_string(F.col("description")).alias("description"), amount(low).alias("salary_min"), amount(high).alias("salary_max"), F.when(known, "INR").alias("salary_currency"),
        F.when(known, "month").alias("salary_period"), pay.raw_repr(low, high, pay.clean_string(F.col("currency")), interval).alias("salary_raw"), F.col("date_posted").cast("timestamp").alias("posted_at"),
    )
    return to_posting(raw)


_SALARY = "salary_min:bigint,salary_max:bigint"
for _board in (
    Board("remoteok", f"id:string,position:string,company:string,url:string,location:string,description:string,{_SALARY},date:string,epoch:bigint", "", _remoteok, 1),
    Board("himalayas", "guid:string,title:string,companyName:string,applicationLink:string,locationRestrictions:array<string>,minSalary:bigint,maxSalary:bigint,currency:string,salaryPeriod:string,pubDate:bigint,description:string,excerpt:string", "jobs", _himalayas, 2, page_limit=100),
    Board("jobicy", "id:bigint,jobTitle:string,companyName:string,url:string,jobGeo:string,jobType:array<string>,salaryMin:bigint,salaryMax:bigint,salaryCurrency:string,salaryPeriod:string,pubDate:string,jobDescription:string", "jobs", jobicy_mapper(), 3, page_limit=50),
    Board("adzuna", "id:string,title:string,company:struct<display_name:string>,location:struct<display_name:string>,redirect_url:string,description:string,salary_min:double,salary_max:double,created:string", "results", adzuna_mapper(), 4),
    Board("jooble", "id:string,title:string,company:string,link:string,location:string,snippet:string,updated:string", "jobs", _jooble, 5),
    Board("unstop", "id:bigint,title:string,subtype:string,updated_at:string,start_date:string,organisation:struct<name:string>,public_url:string,seo_url:string,short_url:string,region:string,details:string,required_skills:array<struct<name:string>>,workfunction:struct<name:string>,regnRequirements:struct<reg_status:string>,jobDetail:struct<show_salary:int,not_disclosed:boolean,min_salary:bigint,max_salary:bigint,currency:string,pay_in:string>", "data.data", unstop_mapper(), 6),
    Board("internshala", "id:string,href:string,title:string,company:string,stipend:string,location:string,ago:string,slug:string", "", _internshala, 7),
    Board("greenhouse", "id:bigint,title:string,company_name:string,location:struct<name:string>,absolute_url:string,content:string,updated_at:string,first_published:string", "jobs", _greenhouse, 8, True),
    Board("lever", "id:string,text:string,hostedUrl:string,workplaceType:string,categories:struct<location:string>,salaryRange:struct<min:bigint,max:bigint,currency:string,interval:string>,createdAt:bigint,description:string", "", _lever, 9, True),
    Board("ashby", "id:string,title:string,organizationName:string,jobUrl:string,applyUrl:string,location:string,isRemote:boolean,isListed:boolean,publishedAt:string,descriptionHtml:string,compensation:struct<summaryComponents:array<struct<compensationType:string,minValue:bigint,maxValue:bigint,currencyCode:string,interval:string>>>", "jobs", _ashby, 10, True),
    Board("smartrecruiters", "id:string,name:string,company:struct<name:string>,ref:string,location:struct<city:string,region:string,country:string,remote:boolean>,releasedDate:string", "content", _smartrecruiters, 11, True),
):
    register(_board)
