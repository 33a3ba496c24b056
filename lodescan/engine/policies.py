"""How each detector's hits are treated: a small table, looked up by detector, then category, then default."""

from __future__ import annotations

from dataclasses import dataclass, fields, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

REQUIRED, BOOST, NONE = "required", "boost", "none"

# Words in the names of neighbouring fields and of fields that are never personal.
IDENTITY_SIBLINGS = (
    r"\b(?:date of birth|dob|birth ?date|birthday|first ?name|last ?name|full ?name|surname|given ?name|family ?name|"
    r"gender|sex|nationality|passport|marital|ssn|national ?id|aadhaar|pan|tax ?id)\b"
)
CARD_SIBLINGS = (
    r"\b(?:cvv|cvc|cvv2|cvc2|csc|expir\w*|exp ?(?:month|year|date|mm|yy)|valid ?(?:thru|till|until)|card ?holder|"
    r"cardholder|card ?type|card ?brand|issuer|pan)\b"
)
BANK_SIBLINGS = (
    r"\b(?:routing|aba|ifsc|swift|bic|sort ?code|iban|bank ?(?:name|code|branch)|branch|beneficiary|account ?holder|micr)\b"
)
HEALTH_SIBLINGS = r"\b(?:patient|diagnosis|icd|procedure|provider|npi|member ?id|insurance|policy|prescription|rx|claim)\b"
TECHNICAL_NUMBERS = (
    r"\b(?:hash|digest|checksum|crc|txn|transaction|trace|span|request|order|invoice|tracking|imei|imsi|serial|barcode|"
    r"ean|upc|isbn|asin|sku|lat|lng|latitude|longitude|epoch|timestamp|pid|port|version|build|revision|counter|seq|"
    r"sequence|offset|size|bytes|count|amount|total|price|balance|score|rating|percent|duration)\b"
)


@dataclass(frozen=True)
class Policy:
    context: str = BOOST
    column_ratio: float = 0.5
    column_min_matches: int = 3
    column_classify: bool = True
    column_requires_validation: bool = False
    min_count: int = 10
    count_promotion: bool = True
    identity: bool = False
    identity_corroboration: bool = False
    negative_fields: str | None = None
    siblings: str | None = None


_number = dict(negative_fields=TECHNICAL_NUMBERS)
_identified = dict(identity_corroboration=True, **_number)
_regional = Policy(REQUIRED, count_promotion=False, siblings=IDENTITY_SIBLINGS, **_identified)
_health = replace(_regional, siblings=HEALTH_SIBLINGS)
_finance = Policy(REQUIRED, siblings=BANK_SIBLINGS, **_identified)
_postal = Policy(REQUIRED, column_ratio=0.8)
_bank_code = Policy(REQUIRED, column_ratio=0.8, count_promotion=False)
_secret = Policy(BOOST, min_count=3)
_technical = Policy(REQUIRED, count_promotion=False)

# The treatment of categories and of single detectors.
CATEGORY_POLICIES = {
    "Credentials and Secrets": _secret,
    "Entropy-Based Secret Detection": Policy(REQUIRED, column_classify=False, count_promotion=False),
    "PII": Policy(BOOST, identity=True),
    "Financial Data": _finance,
    "Regional Compliance": _regional,
    "Healthcare Data (PHI)": _health,
    "Technical Identifier": _technical,
}
DETECTOR_POLICIES = {
    "Email": Policy(NONE, identity=True),
    "Phone Number": Policy(BOOST, identity=True, **_number),
    "PII.PersonName": Policy(BOOST, identity=True),
    "Address": Policy(BOOST, identity=True),
    "Date of Birth": Policy(REQUIRED, identity=True),
    "PII.IPAddress": Policy(BOOST),
    "MAC_ADDRESS": Policy(BOOST),
    "CA_POSTAL_CODE": _postal, "UK_POSTCODE": _postal, "DE_PLZ": _postal,
    "UK_NHS": replace(_health, column_requires_validation=True),
    "GB_UTR": replace(_regional, column_requires_validation=True),
    "Credit Card": replace(_finance, siblings=CARD_SIBLINGS),
    "IBAN": Policy(NONE, identity_corroboration=True, siblings=BANK_SIBLINGS),
    "SWIFT/BIC": replace(_bank_code, siblings=BANK_SIBLINGS),
    "Bank Account": _finance,
    "ABA_ROUTING_NUMBER": replace(_postal, siblings=BANK_SIBLINGS, **_number),
    "Private Key Header": Policy(NONE), "JWT Token": Policy(NONE), "AWS Access Key": Policy(NONE),
    "AWS Secret Access Key": Policy(REQUIRED, min_count=3),
    "Credentials in URL": Policy(NONE), "Basic Auth Credentials": Policy(NONE), "Secret.PasswordHash": Policy(NONE),
    "Encrypted Secret": Policy(NONE),
    "Password Pattern": _secret, "API Key": _secret, "Bearer Token": _secret, "OAuth Token": _secret,
    "High Entropy Secret": Policy(REQUIRED, column_classify=False, count_promotion=False),
    "Secret.TokenLikeValue": _technical,
    "Healthcare Data Detection": Policy(NONE),
    "IMEI": Policy(REQUIRED, **_number), "ICCID": Policy(REQUIRED, **_number),
    "VIN": _technical, "GEO_COORDINATES": _technical,
    "PASSPORT_MRZ": Policy(NONE),
    "IN_IFSC": _bank_code, "AU_BSB": _bank_code, "GB_SORT_CODE": _bank_code,
    "IN_UPI_ID": Policy(BOOST, identity=True),
    "US_EIN": Policy(REQUIRED, **_number),
    "BR_CNPJ": Policy(REQUIRED),
}
# Shorter category names in use.
CATEGORY_NAMES = {
    "Financial": "Financial Data", "Regional": "Regional Compliance", "PHI": "Healthcare Data (PHI)", "Technical": "Technical Identifier",
}


def policy_for(detector: str, category: str, overrides: dict[str, Policy] | None = None) -> Policy:
    category = CATEGORY_NAMES.get(category, category)
    named = DETECTOR_POLICIES | (overrides or {})
    return named.get(detector) or CATEGORY_POLICIES.get(category) or Policy()


_SPARK = {"str": T.StringType(), "float": T.DoubleType(), "int": T.IntegerType(), "bool": T.BooleanType(), "str | None": T.StringType()}


def policy_table(spark: SparkSession, overrides: dict[str, Policy] | None = None) -> DataFrame:
    """Rows (kind, name, policy fields); kind is detector, category or default."""
    rows = [("detector", n, p) for n, p in (DETECTOR_POLICIES | (overrides or {})).items()]
    rows += [("category", n, p) for n, p in CATEGORY_POLICIES.items()]
    rows += [("category", short, CATEGORY_POLICIES[n]) for short, n in CATEGORY_NAMES.items()]
    rows.append(("default", "", Policy()))
    schema = T.StructType([T.StructField("kind", T.StringType()), T.StructField("name", T.StringType())] + [
        T.StructField(f.name, _SPARK[f.type]) for f in fields(Policy)
    ])
    return spark.createDataFrame([(k, n, *(getattr(p, f.name) for f in fields(Policy))) for k, n, p in rows], schema)


def with_policy(df: DataFrame, overrides: dict[str, Policy] | None = None) -> DataFrame:
    """``df`` (detector, category) with a struct column ``policy``; the table is of fixed size and broadcast."""
    table = policy_table(df.sparkSession, overrides)
    packed = F.struct(*[F.col(f.name) for f in fields(Policy)])
    by_name = F.broadcast(table.where("kind = 'detector'").select(F.col("name").alias("_dn"), packed.alias("_dp")))
    by_category = F.broadcast(table.where("kind = 'category'").select(F.col("name").alias("_cn"), packed.alias("_cp")))
    default = Policy()
    plain = F.struct(*[F.lit(getattr(default, f.name)).cast(_SPARK[f.type]).alias(f.name) for f in fields(Policy)])
    joined = df.join(by_name, F.col("detector") == F.col("_dn"), "left").join(by_category, F.col("category") == F.col("_cn"), "left")
    return joined.withColumn("policy", F.coalesce("_dp", "_cp", plain)).drop("_dn", "_dp", "_cn", "_cp")
