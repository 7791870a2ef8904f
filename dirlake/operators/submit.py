"""Company submissions and user registrations as sets of rows to append."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dirlake.functions.scalar import email, first_word, is_empty, last_word, post_html, text, text_area, text_field, url

from .keys import with_keys
from .meta import unpivot, upsert_rows
from .terms import by_slug_or_name, city_and_district

#: The title of a company without one, and the replies to submissions and registrations.
UNNAMED, RECEIVED = "(İsimsiz Firma)", "Firma başvurunuz alındı. Teşekkürler!"
NOT_CREATED, NOTHING_GIVEN = "Firma oluşturulamadı: ", "Content, title, and excerpt are empty."
REGISTERED, KNOWN_EMAIL, NO_LOGIN = "Kayıt başarılı! Giriş yapabilirsiniz.", "Bu e-posta adresi zaten kayıtlı.", "Cannot create a user with an empty login name."


def judged(submissions: DataFrame) -> DataFrame:
    """submissions with the cleaned title and content of each, and error: why it can't become an entity, else null."""
    title = F.coalesce(text_field(F.col("title")), F.lit(UNNAMED))
    content = text(post_html(F.col("description")))
    return submissions.withColumns({"_title": title, "_content": content, "error": F.when((title == "") & (content == ""), NOTHING_GIVEN)})


def submit_companies(submissions: DataFrame, terms: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Entities (pending), attribute rows and term links for submissions (id and the form's fields); one with neither title nor description is left out."""
    submissions = judged(submissions).where("error is null")
    entity = submissions.select("id", F.lit("company").alias("post_type"), F.col("_title").alias("title"), F.col("_content").alias("content"), F.lit("pending").alias("status"))
    fields = {"company_type": text_field(F.col("companyType")), "official_name": text_field(F.col("officialName")), "email": email(F.col("email")), "phone": text_field(F.col("phone")), "website": url(F.col("website")), "postal_code": text_field(F.col("postalCode")), "address": text_area(F.col("address"))}
    meta = unpivot(submissions.select(F.col("id").alias("entity_id"), *[c.alias(k) for k, c in fields.items()]), "entity_id", list(fields))
    placed = city_and_district(by_slug_or_name(submissions.select("id", "sector", "city", "district"), "sector", terms, "sector", "sector_id"), terms)
    found = F.array(*[F.struct(F.lit(t).alias("taxonomy"), F.col(c).alias("term_id")) for t, c in (("sector", "sector_id"), ("location", "city_id"), ("location", "district_id"))])
    links = placed.select(F.col("id").alias("entity_id"), F.inline(found)).where("term_id is not null").distinct()
    return entity, meta, links


def payloads(entities: DataFrame) -> DataFrame:
    """The reply to each submission that became an entity: success, message, postId."""
    return entities.select(F.lit(True).alias("success"), F.lit(RECEIVED).alias("message"), F.col("id").alias("postId"))


def replies(submissions: DataFrame) -> DataFrame:
    """The reply to each submission, in one pass: id, success, message, and postId of those that became an entity."""
    done = F.col("error").isNull()
    message = F.when(done, RECEIVED).otherwise(F.concat(F.lit(NOT_CREATED), "error"))
    return judged(submissions).select("id", done.alias("success"), message.alias("message"), F.when(done, F.col("id")).alias("postId"))


def failed(submissions: DataFrame) -> DataFrame:
    """id and error of the submissions that became no entity."""
    return judged(submissions).where("error is not null").select("id", "error")


def registration_replies(registrations: DataFrame, accounts: DataFrame) -> DataFrame:
    """The reply to each registration: id, success, message, and userId of those that became an account."""
    users, _, _ = register_users(registrations, accounts)
    own = registrations.select("id", email(F.col("email")).alias("email")).join(users.select("id", F.lit(True).alias("_made")), "id", "left")
    done = F.col("_made").isNotNull()
    message = F.when(done, REGISTERED).when(text(F.col("email")) == "", NO_LOGIN).otherwise(KNOWN_EMAIL)
    return own.select("id", done.alias("success"), message.alias("message"), F.when(done, F.col("id")).alias("userId"))


def create_accounts(registrations: DataFrame, accounts: DataFrame, meta: DataFrame) -> tuple[DataFrame, DataFrame]:
    """accounts (id, login, e-mail, names) and attribute rows (meta_id, user_id, key, value) with those of new registrations.

    New accounts get the next ids in the order of the registrations' own. A registration that comes again is refused for its
    e-mail, so its account keeps its id.
    """
    users, fields, _ = register_users(registrations, accounts)
    last = accounts.agg(F.max("id")).first()[0] or 0
    users = with_keys(users.withColumnRenamed("id", "of"), ["of"], "id", last)
    fields = fields.join(users.select(F.col("of").alias("user_id"), F.col("id").alias("account")), "user_id").select(F.col("account").alias("user_id"), "key", "value")
    return accounts.unionByName(users.select(*accounts.columns)), upsert_rows(meta, fields, "user_id")


def open_fields(rows: DataFrame, owner: str, payload: str, allowed: list[str]) -> tuple[DataFrame, DataFrame]:
    """Attribute rows (owner, key, value) of JSON objects in a column, and what is rejected (owner, key, value, error).

    Keys that a form doesn't know are rejected one by one ('key'), texts that are no JSON object ('json') whole. Strings
    are values as they are; numbers, lists and records are their JSON; null is a value that isn't supplied.
    """
    spark = rows.sparkSession
    parsed = rows.select(F.col(owner).alias("_owner"), F.col(payload).alias("_text"), F.try_parse_json(F.col(payload)).alias("_v"))
    is_object = F.coalesce(F.schema_of_variant("_v").startswith("OBJECT"), F.lit(False))
    fields = parsed.where(is_object).lateralJoin(spark.tvf.variant_explode(F.col("_v").outer()))
    value = F.when(F.schema_of_variant("value") == "VOID", None).otherwise(F.col("value").cast("string"))
    fields = fields.select(F.col("_owner").alias(owner), "key", value.alias("value"))
    known = F.col("key").isin(*allowed)
    none = F.lit(None).cast("string")
    bad = parsed.where(~is_object & F.col("_text").isNotNull()).select(F.col("_owner").alias(owner), none.alias("key"), F.col("_text").alias("value"), F.lit("json").alias("error"))
    return fields.where(known & F.col("value").isNotNull()), fields.where(~known).withColumn("error", F.lit("key")).unionByName(bad)


def typed_fields(rows: DataFrame, payload: str, ddl: str) -> DataFrame:
    """rows with the columns of a DDL read from JSON objects in a column, which goes; what a column can't hold is null."""
    from pyspark.sql.types import StructType

    v = F.try_parse_json(F.col(payload))
    return rows.select(*[c for c in rows.columns if c != payload], *[F.try_variant_get(v, f"$.{f.name}", f.dataType.simpleString()).alias(f.name) for f in StructType.fromDDL(ddl).fields])


def register_users(registrations: DataFrame, accounts: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """New accounts, their attribute rows, and rejected registrations (e-mail known, or taken by an earlier id)."""
    own = registrations.withColumn("email", email(F.col("email")))
    first = own.groupBy("email").agg(F.min("id").alias("id"))
    fresh = own.join(first, ["email", "id"], "left_semi").join(accounts.select("email"), "email", "left_anti").where("email <> ''")
    last = F.when(~is_empty(F.col("lastName")), F.col("lastName")).otherwise(last_word(F.col("firstName")))
    users = fresh.select("id", F.col("email").alias("login"), "email", first_word(F.col("firstName")).alias("first_name"), last.alias("last_name"), F.col("firstName").alias("display_name"))
    business = F.col("accountType") == "kurumsal"
    fields = {"phone": text_field(F.col("phone")), "account_type": text_field(F.col("accountType"))}
    fields |= {k: F.when(business, text_field(F.col(c))) for k, c in (("company_name", "companyName"), ("tax_office", "taxOffice"), ("tax_number", "taxNumber"), ("sector", "sector"))}
    meta = unpivot(fresh.select(F.col("id").alias("user_id"), *[c.alias(k) for k, c in fields.items()]), "user_id", list(fields))
    return users, meta, registrations.join(users.select("id"), "id", "left_anti")
