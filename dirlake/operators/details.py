"""Read models: an entity's or term's attributes as typed, nested columns.

A request names the fields it wants; their keys are the only ones that the scan of the attributes looks for, and of lists of
records only the wanted fields are parsed.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from dirlake.functions.scalar import flag, joined, lenient_int, text

from .listing import ordered_lookup
from .meta import attributes
from .terms import first_term


def camel(key: str) -> str:
    head, *rest = key.split("_")
    return head + "".join(x.capitalize() for x in rest)


#: Attributes of each read model, by type.
COMPANY = {
    "text": ["company_type", "email", "phone", "website", "address", "postal_code", "map_lat", "map_lng", "kep_address", "foundation_year", "employee_count", "tax_office", "trade_registry_number", "activity_certificate", "cover_image", "gallery_urls"],
    "flag": ["is_verified"],
    "list": {"working_hours": "array<struct<days:string,time:string>>", "company_services": "array<struct<icon:string,title:string,desc:string>>"},
    "record": {"social": {x: f"{x}_url" for x in ("linkedin", "facebook", "twitter", "instagram")}},
    "named": {"company_services": "services"},
}
EVENT = {
    "text": ["event_type", "start_date", "end_date", "location_type", "venue", "address", "organizer", "price", "registration_link"],
    "flag": ["is_official"],
    "list": {"schedule": "array<struct<time:string,title:string>>", "speakers": "array<struct<name:string,title:string,company:string,image:string>>"},
}
LEAD = {"text": ["lead_type", "status", "budget_string", "expiry_date", "delivery_location", "attachment"], "flag": ["is_hidden_name", "is_premium"], "int": ["view_count", "offer_count"]}
JOB = {"text": ["company_name", "location", "work_type", "experience", "education", "salary", "deadline"], "flag": ["is_featured"]}
SECTOR = {"text": ["sector_icon", "sector_icon_name", "sector_featured_image", "sector_color"], "named": {"sector_icon": "icon", "sector_icon_name": "iconName", "sector_featured_image": "featuredImage", "sector_color": "color"}}
LOCATION = {"text": ["location_type", "map_lat", "map_lng"], "named": {"location_type": "type", "map_lat": "lat", "map_lng": "lng"}}


def outputs(model: dict) -> dict[str, tuple[str, str | dict]]:
    """Fields of a model: how each is read, and its key (or keys by name, for a record)."""
    named = model.get("named", {})
    out: dict[str, tuple[str, str | dict]] = {}
    for kind in ("text", "flag", "int", "list"):
        out |= {named.get(k, camel(k)): (kind, k) for k in model.get(kind, [])}
    return out | {name: ("record", own) for name, own in model.get("record", {}).items()}


def requested(model: dict, fields: Sequence[str] | None) -> tuple[list[str], list[Column]]:
    """Keys and columns of the fields asked for, in their order; None is all. 'speakers.name' asks for a part of a field."""
    known = outputs(model)
    parts: dict[str, list[str]] = {}
    for field in known if fields is None else fields:
        name, _, part = field.partition(".")
        if name not in known:
            raise ValueError(f"no field {name}")
        parts.setdefault(name, [])
        parts[name] += [part] if part else []
    whole = set(known if fields is None else [f for f in fields if "." not in f])
    keys, columns = [], []
    for name, some in parts.items():
        kind, key = known[name]
        some = [] if name in whole else some
        if kind == "record":
            own = {x: k for x, k in key.items() if not some or x in some}
            unknown = set(some) - set(own)
            keys += own.values()
            column = F.struct(*[text(F.col(k)).alias(x) for x, k in own.items()])
        elif kind == "list":
            items = ArrayType(StructType(StructType.fromDDL(f"x {model['list'][key]}")["x"].dataType.elementType.fields))
            unknown = set(some) - set(items.elementType.names)
            if some:
                items = ArrayType(StructType([f for f in items.elementType.fields if f.name in some]))
            keys.append(key)
            column = F.coalesce(F.from_json(key, items), F.array().cast(items))
        else:
            unknown = set(some)
            keys.append(key)
            column = {"text": text, "flag": flag, "int": lambda c: lenient_int(c).cast("int")}[kind](F.col(key))
        if unknown:
            raise ValueError(f"{name} has no field {', '.join(sorted(unknown))}")
        columns.append(column.alias(name))
    return keys, columns


def read(model: dict, owners: DataFrame, meta: DataFrame, fields: Sequence[str] | None = None, entity: str = "id", owner: str = "entity_id") -> DataFrame:
    """The owners' id and the fields asked for; a missing text is empty, a missing or bad list is an empty one."""
    keys, columns = requested(model, fields)
    return attributes(owners.select(entity), meta, keys, entity, owner).select(entity, *columns)


def company_details(entities: DataFrame, meta: DataFrame, fields: Sequence[str] | None = None, news: bool = False) -> DataFrame:
    """id and the fields asked for of each company, by default the 20 that its own attributes give.

    relatedNews, if asked for or with news, is the list of published news (id, title) that the company names, in its order.
    """
    companies = entities.where("post_type = 'company'")
    own = None if fields is None else [f for f in fields if f != "relatedNews"]
    out = companies.select("id") if own == [] else read(COMPANY, companies, meta, own)
    if not news and (fields is None or "relatedNews" not in fields):
        return out
    lists = related_news(entities, meta).groupBy("id").agg(F.sort_array(F.collect_list(F.struct("pos", F.col("news_id").alias("id"), "title"))).alias("found"))  # as long as the company's own list
    lists = lists.select("id", F.transform("found", lambda x: F.struct(x["id"].alias("id"), x["title"].alias("title"))).alias("relatedNews"))
    none = F.array().cast(lists.schema["relatedNews"].dataType)
    return out.join(lists, "id", "left").withColumn("relatedNews", F.coalesce("relatedNews", none))


def related_news(entities: DataFrame, meta: DataFrame) -> DataFrame:
    """id, pos, news_id, title: the news that companies list, in list order; unknown ids and repeats are left out."""
    own = attributes(entities.where("post_type = 'company'").select("id").distinct(), meta, ["related_news_ids"])
    lists = own.select("id", F.transform(F.coalesce(F.from_json("related_news_ids", "array<string>"), F.array().cast("array<string>")), lenient_int).alias("ids"))
    news = entities.where("post_type = 'post' and status = 'publish'").select(F.col("id").alias("news_id"), "title")
    return ordered_lookup(lists, "id", "ids", news, "news_id")


def event_details(entities: DataFrame, meta: DataFrame, fields: Sequence[str] | None = None) -> DataFrame:
    return read(EVENT, entities.where("post_type = 'event'"), meta, fields)


def lead_details(entities: DataFrame, meta: DataFrame, fields: Sequence[str] | None = None) -> DataFrame:
    return read(LEAD, entities.where("post_type = 'lead'"), meta, fields)


def job_details(entities: DataFrame, meta: DataFrame, fields: Sequence[str] | None = None) -> DataFrame:
    return read(JOB, entities.where("post_type = 'career'"), meta, fields)


def sector_details(terms: DataFrame, meta: DataFrame, fields: Sequence[str] | None = None) -> DataFrame:
    return read(SECTOR, terms.where("taxonomy = 'sector'"), meta, fields, "term_id", "term_id")


def location_details(terms: DataFrame, meta: DataFrame, fields: Sequence[str] | None = None) -> DataFrame:
    return read(LOCATION, terms.where("taxonomy = 'location'"), meta, fields, "term_id", "term_id")


def full_address(addresses: DataFrame, links: DataFrame, terms: DataFrame) -> DataFrame:
    """entity_id and full_address: address, ', ' and the name of the first location; never null."""
    first = first_term(links, terms, "location")
    return addresses.join(first, "entity_id", "left").select("entity_id", joined(F.col("address"), F.lit(", "), F.col("term_name")).alias("full_address"))
