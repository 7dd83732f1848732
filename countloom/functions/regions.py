"""Region schemes as small tables; Spark chooses how to join them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Results must use these names and codes.
WHO_REGIONS = {
    "PAHO": [
        "Anguilla", "Antigua and Barbuda", "Argentina", "Aruba", "Bahamas", "Barbados", "Belize", "Bermuda", "Bolivia",
        "Bonaire, Saint Eustatius and Saba", "Brazil", "Cayman Islands", "Chile", "Colombia", "Costa Rica", "Cuba", "Curacao", "Dominica",
        "Dominican Republic", "Ecuador", "El Salvador", "French Guiana", "Grenada", "Guadeloupe", "Guatemala", "Guyana", "Haiti", "Honduras",
        "Jamaica", "Martinique", "Mexico", "Montserrat", "Nicaragua", "Panama", "Paraguay", "Peru", "Puerto Rico", "Saint Barthelemy",
        "Saint Kitts and Nevis", "Saint Lucia", "Saint Martin", "Saint Vincent and the Grenadines", "Sint Maarten", "Suriname",
        "Trinidad and Tobago", "Turks and Caicos Islands", "United States of America", "Uruguay", "Venezuela", "Virgin Islands (UK)",
        "Virgin Islands (US)",
    ],
    "WPRO": [
        "American Samoa", "Australia", "Brunei Darussalam", "Cambodia", "China", "Cook Islands", "Fiji", "French Polynesia", "Guam", "Hong Kong",
        "Japan", "Kiribati", "Lao People's Democratic Republic", "Macau", "Malaysia", "Marshall Islands", "Micronesia (Federated States of)",
        "Nauru", "New Caledonia", "Niue", "Northern Mariana Islands", "Palau", "Papua New Guinea", "Philippines", "Pitcairn", "Republic of Korea",
        "Samoa", "Singapore", "Solomon Islands", "Taiwan", "Tokelau", "Tonga", "Tuvalu", "Vanuatu", "Viet Nam", "Wallis and Futuna",
    ],
    "SEARO": [
        "Bangladesh", "Bhutan", "India", "Indonesia", "Maldives", "Myanmar", "Nepal", "Sri Lanka", "Thailand", "Timor-Leste",
    ],
    "EMRO": [
        "Afghanistan", "Pakistan", "Saudi Arabia", "Oman", "Yemen", "Sudan", "Djibouti", "Egypt", "Somalia", "Iran (Islamic Republic of)",
    ],
    "AFRO": [
        "Angola", "Benin", "Burkina Faso", "Cabo Verde", "Cameroon", "Central African Republic", "Chad", "Cote D'ivoire", "Eritrea", "Ethiopia",
        "Ghana", "Guinea", "Kenya", "Mali", "Mauritania", "Mauritius", "Mayotte", "Niger", "Reunion", "Sao Tome and Principe", "Senegal",
        "Seychelles", "Togo", "United Republic of Tanzania", "Comoros", "Democratic Republic of Congo", "Gabon", "Madagascar", "Mozambique",
        "Nigeria", "South Sudan", "Burundi", "Congo", "Equatorial Guinea", "Gambia", "Guinea-Bissau", "Liberia", "Malawi", "Namibia", "Rwanda",
        "Sierra Leone", "Uganda", "Zambia", "Zimbabwe",
    ],
    "EURO": [
        "France", "Italy", "Spain", "Croatia", "Portugal",
    ],
}
SCHEME_CODES = [
    ("East & Southeast Asia", ["TWN"]),
    ("Sub-Saharan Africa", ["MYT", "REU"]),
    ("Pacific Islands", ["WLF"]),
    ("South America", ["ARG", "BOL", "BRA", "CHL", "COL", "ECU", "GUF", "GUY", "PRY", "PER", "SUR", "URY", "VEN"]),
    ("North & Central America", ["BLZ", "CRI", "SLV", "GTM", "HND", "MEX", "NIC", "PAN", "USA"]),
    (
        "Caribbean",
        [
            "AIA", "ATG", "ABW", "BHS", "BRB", "BES", "BMU", "VGB", "CYM", "CUB", "CUW", "DMA", "DOM", "GRD", "GLP", "HTI", "JAM", "MTQ", "MSR",
            "PRI", "BLM", "KNA", "LCA", "MAF", "VCT", "SXM", "TTO", "TCA", "VIR",
        ],
    ),
    ("East & Southeast Asia", ["BRN", "KHM", "IDN", "LAO", "MYS", "MMR", "PHL", "SGP", "THA", "TLS", "VNM"]),
    ("Pacific Islands", ["AUS", "NZL"]),
]
SCHEME_SUBREGIONS = [
    ("East & Southeast Asia", ["Eastern Asia", "South-eastern Asia"]),
    ("South Asia", ["Southern Asia"]),
    ("Pacific Islands", ["Melanesia", "Micronesia", "Polynesia"]),
    ("Sub-Saharan Africa", ["Sub-Saharan Africa", "Western Africa", "Eastern Africa", "Middle Africa", "Southern Africa"]),
    ("Europe, Middle East & North Africa", ["Western Asia", "Northern Africa"]),
]
SCHEME_REGIONS = [("Europe, Middle East & North Africa", "Europe")]


def who_regions(spark: SparkSession, *, upper: bool = True) -> DataFrame:
    """series, region: the list of names by WHO region."""
    rows = [(name, region) for region, names in WHO_REGIONS.items() for name in names]
    out = spark.createDataFrame(rows, "series string, region string")
    return out.withColumn("series", F.upper("series")) if upper else out


def add_region(df: DataFrame, regions: DataFrame, *, series: str = "series", name: str = "region") -> DataFrame:
    """Left join with a two-column list of names; other names get null."""
    own = regions.select(F.col("series").alias(series), F.col("region").alias(name))
    return df.join(own, series, "left")


def scheme(codes: DataFrame) -> DataFrame:
    """iso, scheme_region: codes (iso, un_region, un_subregion) by the first rule that
    fits: own lists of codes, then the UN subregion, then the UN region."""
    rule = F.when(F.col("iso").isNull(), F.lit("Other"))
    for label, own in SCHEME_CODES:
        rule = rule.when(F.col("iso").isin(own), label)
    for label, own in SCHEME_SUBREGIONS:
        rule = rule.when(F.col("un_subregion").isin(own), label)
    for label, own in SCHEME_REGIONS:
        rule = rule.when(F.col("un_region") == own, label)
    return codes.select("iso", rule.otherwise("Other").alias("scheme_region")).distinct()


def add_scheme(df: DataFrame, codes: DataFrame, *, iso: str = "iso") -> DataFrame:
    return df.join(scheme(codes).withColumnRenamed("iso", iso), iso, "left")
