"""Country names, and collaboration between countries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from inkmesh.functions.text import ascii_fold, lower, title_case, trim
from inkmesh.plans.staging import stage

# Names, ISO codes and spellings of countries.
COUNTRIES = """
US USA United States=usa,u.s.a,u.s.,united states of america,america
CN CHN China=peoples r china,people's republic of china,peoples republic of china,pr china,p.r. china,mainland china
GB GBR United Kingdom=england,scotland,wales,north ireland,northern ireland,uk,u.k.,great britain,britain
KR KOR South Korea=korea,republic of korea,korea (south),s korea,south korea
KP PRK North Korea=north korea,dem people's rep korea
RU RUS Russia=russian federation,ussr
VN VNM Vietnam=viet nam
TR TUR Turkey=turkiye
CZ CZE Czech Republic=czechia
IR IRN Iran=islamic republic of iran
AE ARE United Arab Emirates=u arab emirates,uae
NL NLD Netherlands=the netherlands,holland
TW TWN Taiwan=republic of china,taiwan roc
DE DEU Germany=fed rep ger,west germany,deutschland
ES ESP Spain=espana
IT ITA Italy=italia
BR BRA Brazil=brasil
SA SAU Saudi Arabia=kingdom of saudi arabia,ksa
RS SRB Serbia=serbia monteneg,serbia and montenegro,yugoslavia
CD COD DR Congo=dem rep congo,democratic republic of congo,zaire
FR FRA France=
JP JPN Japan=
IN IND India=
CA CAN Canada=
AU AUS Australia=
CH CHE Switzerland=
SE SWE Sweden=
NO NOR Norway=
DK DNK Denmark=
FI FIN Finland=
PL POL Poland=
PT PRT Portugal=
AT AUT Austria=
BE BEL Belgium=
GR GRC Greece=
IE IRL Ireland=
IL ISR Israel=
EG EGY Egypt=
ZA ZAF South Africa=
NG NGA Nigeria=
KE KEN Kenya=
MX MEX Mexico=mexique
AR ARG Argentina=
CL CHL Chile=
CO COL Colombia=
PE PER Peru=
BD BGD Bangladesh=
PK PAK Pakistan=
ID IDN Indonesia=
MY MYS Malaysia=
SG SGP Singapore=
TH THA Thailand=
PH PHL Philippines=
UA UKR Ukraine=
RO ROU Romania=
HU HUN Hungary=
MA MAR Morocco=
DZ DZA Algeria=
ET ETH Ethiopia=
JO JOR Jordan=
IQ IRQ Iraq=
MZ MOZ Mozambique=
AF AFG Afghanistan=
AL ALB Albania=
AD AND Andorra=
AO AGO Angola=
AG ATG Antigua and Barbuda=antigua & barbu
AM ARM Armenia=
AZ AZE Azerbaijan=
BS BHS Bahamas=the bahamas
BH BHR Bahrain=
BB BRB Barbados=
BY BLR Belarus=byelarus
BZ BLZ Belize=
BJ BEN Benin=
BT BTN Bhutan=
BO BOL Bolivia=plurinational state of bolivia
BA BIH Bosnia and Herzegovina=bosnia & herceg,bosnia,bosnia & herzegovina
BW BWA Botswana=
BN BRN Brunei=brunei darussalam
BG BGR Bulgaria=
BF BFA Burkina Faso=
BI BDI Burundi=
KH KHM Cambodia=
CM CMR Cameroon=
CV CPV Cape Verde=cabo verde
CF CAF Central African Republic=cent afr republ
TD TCD Chad=
KM COM Comoros=
CG COG Congo=rep congo,republic of congo,congo republic
CR CRI Costa Rica=
CI CIV Ivory Coast=cote d'ivoire,cote divoire
HR HRV Croatia=
CU CUB Cuba=
CY CYP Cyprus=
DJ DJI Djibouti=
DM DMA Dominica=
DO DOM Dominican Republic=dominican rep
EC ECU Ecuador=
SV SLV El Salvador=
GQ GNQ Equatorial Guinea=
ER ERI Eritrea=
EE EST Estonia=
SZ SWZ Eswatini=swaziland
FJ FJI Fiji=
GA GAB Gabon=
GM GMB Gambia=the gambia
GE GEO Georgia=republic of georgia
GH GHA Ghana=
GD GRD Grenada=
GT GTM Guatemala=
GN GIN Guinea=
GW GNB Guinea-Bissau=guinea bissau
GY GUY Guyana=
HT HTI Haiti=
HN HND Honduras=
HK HKG Hong Kong=hong kong sar,hong kong sar china
IS ISL Iceland=
JM JAM Jamaica=
KZ KAZ Kazakhstan=
KI KIR Kiribati=
XK XKX Kosovo=
KW KWT Kuwait=
KG KGZ Kyrgyzstan=kyrgyz republic
LA LAO Laos=lao people's democratic republic,lao pdr
LV LVA Latvia=
LB LBN Lebanon=
LS LSO Lesotho=
LR LBR Liberia=
LY LBY Libya=libyan arab jamahiriya
LI LIE Liechtenstein=
LT LTU Lithuania=
LU LUX Luxembourg=
MO MAC Macao=macau,macao sar
MG MDG Madagascar=
MW MWI Malawi=
MV MDV Maldives=
ML MLI Mali=
MT MLT Malta=
MH MHL Marshall Islands=
MR MRT Mauritania=
MU MUS Mauritius=
FM FSM Micronesia=federated states of micronesia
MD MDA Moldova=republic of moldova
MC MCO Monaco=
MN MNG Mongolia=
ME MNE Montenegro=
MM MMR Myanmar=burma
NA NAM Namibia=
NR NRU Nauru=
NP NPL Nepal=
NZ NZL New Zealand=
NI NIC Nicaragua=
NE NER Niger=
MK MKD North Macedonia=macedonia,republic of north macedonia
OM OMN Oman=
PW PLW Palau=
PS PSE Palestine=state of palestine
PA PAN Panama=
PG PNG Papua New Guinea=papua n guinea
PY PRY Paraguay=
PR PRI Puerto Rico=
QA QAT Qatar=
RW RWA Rwanda=
KN KNA Saint Kitts and Nevis=st kitts & nevi
LC LCA Saint Lucia=st lucia
VC VCT Saint Vincent and the Grenadines=st vincent
WS WSM Samoa=
SM SMR San Marino=
ST STP Sao Tome and Principe=sao tome & prin
SN SEN Senegal=
SC SYC Seychelles=
SL SLE Sierra Leone=
SK SVK Slovakia=slovak republic
SI SVN Slovenia=
SB SLB Solomon Islands=
SO SOM Somalia=
SS SSD South Sudan=
LK LKA Sri Lanka=
SD SDN Sudan=
SR SUR Suriname=
SY SYR Syria=syrian arab republic
TJ TJK Tajikistan=
TZ TZA Tanzania=united republic of tanzania
TL TLS Timor-Leste=east timor
TG TGO Togo=
TO TON Tonga=
TT TTO Trinidad and Tobago=trinidad tobago,trinidad & tobago
TN TUN Tunisia=
TM TKM Turkmenistan=
TV TUV Tuvalu=
UG UGA Uganda=
UY URY Uruguay=
UZ UZB Uzbekistan=
VU VUT Vanuatu=
VA VAT Vatican City=holy see,vatican
VE VEN Venezuela=bolivarian republic of venezuela
YE YEM Yemen=
ZM ZMB Zambia=
ZW ZWE Zimbabwe=
"""


def country_aliases(spark: SparkSession) -> DataFrame:
    """alias, name: every spelling, lower case and folded; ISO codes in upper case as they stand."""
    rows = []
    for line in COUNTRIES.strip().splitlines():
        head, _, aliases = line.partition("=")
        two, three, name = head.split(" ", 2)
        rows += [(a, name) for a in [name.lower(), *filter(None, aliases.split(","))]] + [(two, name), (three, name)]
    return spark.createDataFrame(rows, "alias string, name string")


def _candidates(c: Column) -> Column:
    """What of an address may name a country, most telling first: the whole, its last part, its last five to one words, its last three-letter code."""
    whole = F.regexp_replace(lower(ascii_fold(trim(F.regexp_replace(c, r"\s+", " ")))), r"[.; ]+$", "")
    last = trim(F.element_at(F.split(whole, "[,;]"), -1))
    words = F.split(last, " ")
    tails = F.transform(F.array(*[F.lit(k) for k in (5, 4, 3, 2, 1)]), lambda k: F.array_join(F.slice(words, F.greatest(F.size(words) - k + 1, F.lit(1)), k), " "))
    own = F.when(trim(c).rlike("^([A-Z][A-Za-z]|[A-Za-z]{3})$"), F.upper(trim(c)))
    code = F.regexp_extract(trim(c), r"(?:^|[\s,;])([A-Z]{3})$", 1)  # two letters at the end may be a state
    return F.filter(F.concat(F.array(own, whole, last), tails, F.array(code)), lambda x: F.coalesce(x, F.lit("")) != "")


def normalise_countries(df: DataFrame, column: str, aliases: DataFrame | None = None, keep_unknown: bool = False) -> DataFrame:
    """df with `column` as a country's name; empty, or its title case, where no spelling fits.

    Distinct values are resolved once, by an equi-join of their candidates with the aliases, and joined back.
    """
    aliases = country_aliases(df.sparkSession) if aliases is None else aliases
    values = df.select(F.col(column).alias("v")).where("v is not null").distinct()
    tried = values.select("v", F.posexplode(_candidates(F.col("v"))).alias("pos", "alias"))
    found = tried.join(aliases, "alias").groupBy("v").agg(F.min_by("name", "pos").alias("name"))
    rest = title_case(trim(F.col(column))) if keep_unknown else F.lit("")
    out = df.join(found, df[column] == found.v, "left")
    return out.withColumn(column, F.when(F.col(column).isNotNull(), F.coalesce("name", rest))).drop("v", "name")


def collaboration(inc: DataFrame) -> DataFrame:
    """a, b, w: documents that two countries share."""
    from inkmesh.operators.network import cooccurrence

    return cooccurrence(inc)


def countries_of(records: DataFrame, aliases: DataFrame | None = None, keep_unknown: bool = False) -> DataFrame:
    """doc, country, countries: each record's countries under one name each, and how many it has; those of no known spelling go unless kept."""
    each = records.select(F.col("rec_id").alias("doc"), F.explode("countries").alias("country"))
    named = normalise_countries(each, "country", aliases, keep_unknown).where("country <> ''").distinct()
    return named.join(named.groupBy("doc").agg(F.count(F.lit(1)).alias("countries")), "doc")


def country_summary(records: DataFrame, countries: DataFrame | None = None) -> DataFrame:
    """country, docs, cites, h, shared_docs, first_year, last_year, growth (a year, compound; 0 within one year or without years)."""
    from inkmesh.operators.stats import h_index

    own = countries_of(records) if countries is None else countries
    docs = records.select(F.col("rec_id").alias("doc"), F.when(F.col("year") != 0, F.col("year")).alias("year"), F.coalesce("cites", F.lit(0)).alias("cites"))
    each = own.join(docs, "doc")
    base = each.groupBy("country").agg(F.count(F.lit(1)).alias("docs"), F.sum("cites").cast("long").alias("cites"), F.count_if(F.col("countries") > 1).alias("shared_docs"))
    years = each.where("year is not null").groupBy("country", "year").agg(F.count(F.lit(1)).alias("n"))
    ends = years.groupBy("country").agg(F.min("year").alias("first_year"), F.max("year").alias("last_year"), F.min_by("n", "year").alias("n0"), F.max_by("n", "year").alias("n1"))
    span = F.col("last_year") - F.col("first_year")
    growth = F.when(span > 0, F.pow(F.col("n1") / F.col("n0"), 1 / span) - 1).otherwise(0.0)
    return base.join(h_index(each, ["country"]), "country").join(ends, "country", "left").select("country", "docs", "cites", "h", "shared_docs", "first_year", "last_year", growth.alias("growth"))


def country_years(records: DataFrame, countries: DataFrame | None = None) -> DataFrame:
    """country, year, docs, cites_per_doc: every year from a country's first to its last; years without documents hold zeros."""
    own = countries_of(records) if countries is None else countries
    dated = records.where("year is not null and year <> 0").select(F.col("rec_id").alias("doc"), "year", F.coalesce("cites", F.lit(0)).alias("cites"))
    n = own.join(dated, "doc").groupBy("country", "year").agg(F.count(F.lit(1)).alias("docs"), F.avg("cites").alias("cites_per_doc"))
    every = n.groupBy("country").agg(F.explode(F.sequence(F.min("year"), F.max("year"))).alias("year"))
    return every.join(n, ["country", "year"], "left").select("country", "year", F.coalesce("docs", F.lit(0).cast("long")).alias("docs"), F.coalesce("cites_per_doc", F.lit(0.0)).alias("cites_per_doc"))


#: How many of each unit a country's profile names.
PROFILE = {"keywords": 12, "orgs": 6, "authors": 6, "sources": 5}


def country_tops(records: DataFrame, countries: DataFrame | None = None, tops: dict[str, int] = PROFILE, labels: bool = True) -> DataFrame:
    """country, what, place, key, label, docs: the most frequent units of every country's records, equals by key; without `labels` no label.

    Organisations count in records of one country only, as records do not say which of them lies where.
    """
    from inkmesh.operators.units import first_labels, incidence

    own = stage(countries_of(records), "countries") if countries is None else countries  # read for each kind of unit
    parts = []
    for what, most in tops.items():
        inc = incidence(records, what)
        n = inc.select("doc", "key").join(own.where("countries = 1") if what == "orgs" else own, "doc").groupBy("country", "key").agg(F.count(F.lit(1)).alias("docs"))
        # rows beyond the limit go before the shuffle, so a country with most of all keys is no single task's load
        ranked = n.withColumn("place", F.row_number().over(Window.partitionBy("country").orderBy(F.desc("docs"), "key"))).where(F.col("place") <= most)
        ranked = ranked.join(first_labels(inc), "key") if labels else ranked
        parts.append(ranked.select("country", F.lit(what).alias("what"), F.col("place").cast("long").alias("place"), "key", *["label"] * labels, "docs"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
