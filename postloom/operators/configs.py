"""Board search configurations: from urls, from forms, and their checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postloom import fixed_values as fv
from postloom.functions import urls
from postloom.functions.expr import is_blank, nonblank


def from_urls(df: DataFrame) -> DataFrame:
    """Configurations of search urls (``url``, ``company_name``); other sites give no row.

    A workday page names its tenant only in live traffic and an oraclecloud page its site number, so
    ``tenant_site`` and ``finder`` columns bring them when they are known; without them there is no
    configuration for those boards.
    """
    there = set(df.columns)

    def given(name: str) -> Column:
        return F.col(name) if name in there else F.lit(None).cast("string")

    staged = (
        df.withColumn("config_type", urls.config_type("url"))
        .where(F.col("config_type").isNotNull())
        .withColumn("_params", urls.search_params("url", "config_type"))
        .withColumn("_finder", urls.finder_params(given("finder")))
        .withColumn("_base", urls.base_url(F.col("url")))
        .withColumn("_tenant", nonblank(given("tenant_site")))
    )
    kind = F.col("config_type")

    def found(name: str, default: str = "") -> Column:
        return F.coalesce(F.try_element_at("_finder", F.lit(name)), F.lit(default))

    company = F.col("company_name")
    facets = F.when(
        F.size(F.map_keys("_params")) > 0,
        F.concat(F.lit(',"search_params":'), urls.params_json(F.col("_params"))),
    ).otherwise(F.lit(""))
    workday = F.concat(
        F.regexp_replace(
            urls.params_json(
                F.create_map().cast("map<string,array<string>>"),
                company_name=company, tenant_site=F.col("_tenant"), base_url=F.col("_base"),
            ),
            r"\}$", "",
        ),
        facets, F.lit("}"),
    )
    oracle = urls.params_json(
        F.col("_params"), company_name=company, siteNumber=found("siteNumber"),
        facetsList=found("facetsList"), sortBy=found("sortBy", "RELEVANCY"), base_url=F.col("_base"),
    )
    plain = urls.params_json(F.col("_params"), company_name=company, base_url=F.col("_base"))
    usable = (
        F.when(kind == "workday", F.col("_tenant").isNotNull())
        .when(kind == "oraclecloud", F.size(F.map_keys("_finder")) > 0)
        .otherwise(F.lit(True))
    )
    return staged.where(usable).select(
        *df.columns,
        "config_type",
        urls.config_key(company).alias("config_key"),
        F.col("_base").alias("base_url"),
        F.when(kind == "workday", workday).when(kind == "oraclecloud", oracle).otherwise(plain)
        .alias("config_json"),
    )


def from_forms(forms: DataFrame) -> DataFrame:
    """Configuration JSON of submitted forms; blank fields are left out, bad JSON is ignored."""
    there = set(forms.columns)

    def text(name: str) -> Column:
        return nonblank(F.col(name) if name in there else F.lit(None).cast("string"))

    def number(name: str) -> Column:
        return text(name).try_cast("bigint")

    def parsed(name: str) -> Column:
        return F.try_parse_json(text(name))

    def body(**fields: Column) -> Column:
        return F.to_json(
            F.struct(
                F.coalesce(F.col("company_name"), F.lit("")).alias("company_name"),
                F.coalesce(F.col("base_url"), F.lit("")).alias("base_url"),
                *[c.alias(n) for n, c in fields.items()],
            )
        )

    def with_extra(base: Column) -> Column:
        extra = F.when(parsed("extra_params").isNotNull(), text("extra_params"))
        inner = F.regexp_extract(extra, r"(?s)^\s*\{(.*)\}\s*$", 1)
        return F.when(
            F.trim(inner) != "", F.concat(F.regexp_replace(base, r"\}$", ","), inner, F.lit("}"))
        ).otherwise(base)

    places = F.filter(
        F.transform(F.split(text("usajobs_l"), r"\R"), lambda x: F.trim(x)), lambda x: x != ""
    )
    kind = F.col("config_type")
    config = (
        F.when(
            kind == "workday",
            body(tenant_site=text("tenant_site"), search_params=parsed("search_params")),
        )
        .when(
            kind == "oraclecloud",
            body(
                siteNumber=text("siteNumber"), locationId=text("locationId"),
                facetsList=text("facetsList"), radius=number("radius"),
                radiusUnit=text("radiusUnit"), sortBy=text("sortBy"), limit=number("limit"),
                selectedCategoriesFacet=text("selectedCategoriesFacet"),
            ),
        )
        .when(kind == "eightfold", with_extra(body(domain=text("domain"), location=text("location"))))
        .when(kind == "usajobs", with_extra(body(l=F.when(F.size(places) > 0, places))))
        .otherwise(F.coalesce(text("config_json"), F.lit("{}")))
    )
    return forms.withColumn("config_json", config)


def conflicts(configs: DataFrame) -> DataFrame:
    """Owners with two usajobs configurations, or two of one type with the same base url."""
    usajobs = F.col("config_type") == "usajobs"
    base = F.when(usajobs, F.lit("")).otherwise(
        F.regexp_replace(F.get_json_object("config_json", "$.base_url"), "/+$", "")
    )
    multi = F.col("config_type").isin(fv.MULTI_TENANT_SITES)
    return (
        configs.withColumn("base_url", base)
        .where(usajobs | (multi & ~is_blank("base_url")))
        .groupBy("owning_user", "config_type", "base_url")
        .agg(F.count(F.lit(1)).cast("bigint").alias("configs"))
        .where(F.col("configs") > 1)
    )


def search_urls(configs: DataFrame) -> DataFrame:
    return configs.withColumn("search_url", urls.search_url("config_type", "config_json"))
