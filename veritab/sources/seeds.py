"""The seed catalogs of a run: small ones stated here, large ones read from files.

A folder may hold category_dict.csv (variant, category), region_dict.csv (variant, region),
cities.csv (city, region), phrases.csv (phrase, region) and aliases.csv (source, client_code,
entity_id, client_name, region), each with its header; an absent file is an empty catalog.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.catalog import Config

# The regions.
REGIONS = [
    "AMAZONAS", "ANZOATEGUI", "APURE", "ARAGUA", "BARINAS", "BOLIVAR", "CARABOBO", "COJEDES", "DELTA AMACURO", "DISTRITO CAPITAL", "FALCON", "GUARICO",
    "LARA", "MERIDA", "MIRANDA", "MONAGAS", "NUEVA ESPARTA", "PORTUGUESA", "SUCRE", "TACHIRA", "TRUJILLO", "VARGAS", "YARACUY", "ZULIA",
]
# Other names of regions that may follow a title, and names that need none.
OTHER_NAMES = {
    "DTTO CAPITAL": "DISTRITO CAPITAL", "DTO CAPITAL": "DISTRITO CAPITAL",
    "NVA ESPARTA": "NUEVA ESPARTA", "N ESPARTA": "NUEVA ESPARTA", "ISLA DE MARGARITA": "NUEVA ESPARTA", "MARGARITA": "NUEVA ESPARTA",
    "DELTA": "DELTA AMACURO", "LA GUAIRA": "VARGAS", "ANZOA": "ANZOATEGUI", "ANZ": "ANZOATEGUI",
}
BARE_NAMES = {"DISTRITO CAPITAL": "DISTRITO CAPITAL", "DISTRITO FEDERAL": "DISTRITO CAPITAL", "DTTO CAPITAL": "DISTRITO CAPITAL", "DTO CAPITAL": "DISTRITO CAPITAL"}
# The categories with their groups and codes.
CATEGORIES = [
    ("Abastos", "TRADE TRADICIONAL", "DTT-01"),
    ("Bodegas", "TRADE TRADICIONAL", "DTT-02"),
    ("Bodegones", "BODEGONES", "DTT-03"),
    ("Carniceria, charcuteria y Frigorifico", "TRADE TRADICIONAL", "DTT-04"),
    ("Farmacias", "FARMACIAS", "DTT-05"),
    ("Horeca", "HORECA", "DTT-06"),
    ("Kioscos", "TRADE TRADICIONAL", "DTT-07"),
    ("Licorerias y Bares", "TRADE TRADICIONAL", "DTT-08"),
    ("Mayoristas", "MAYORISTAS", "DTT-09"),
    ("Otros", "OTROS", "DTT-10"),
    ("Panaderias y Pastelerias", "TRADE TRADICIONAL", "DTT-11"),
    ("SMI", "SMI", "DTT-12"),
    ("SMI - Mini Market", "SMI", "DTT-13"),
    ("Tiendas de conveniencias", "TIENDAS DE CONVENIENCIA", "DTT-14"),
]
# Category names of the catalog before, and today's.
LEGACY = {
    "ABASTO": "Abastos",
    "BODEGA": "Bodegas",
    "PUESTO DE MERCADO": "Abastos",
    "KIOSCO": "Kioscos",
    "PANADERIA": "Panaderias y Pastelerias",
    "PASTELERIA": "Panaderias y Pastelerias",
    "CARNICERIA / CHARCUTERIA / FRIGORIFICO": "Carniceria, charcuteria y Frigorifico",
    "LICORERIA": "Licorerias y Bares",
    "CONFITERIA": "Kioscos",
    "FARMACIA TRADICIONAL (MOSTRADOR)": "Farmacias",
    "PERFUMERIA TRADICIONAL": "Otros",
    "FERRETERIA / QUINCALLERIA": "Otros",
    "SUPERMERCADO INDEPENDIENTE GRANDE": "SMI",
    "SUPERMERCADO INDEPENDIENTE MEDIANO": "SMI",
    "SUPERMERCADO INDEPENDIENTE PEQUEÑO": "SMI",
    "AUTOMERCADO": "SMI",
    "MINI MARKET": "SMI - Mini Market",
    "CADENA NACIONAL": "Otros",
    "CADENA REGIONAL": "Otros",
    "HIPERMERCADO / CASH & CARRY": "Otros",
    "FARMACIA CON AUTOSERVICIO": "Farmacias",
    "FARMACIA CADENA": "Farmacias",
    "FARMACIA MODERNA INDEPENDIENTE": "Farmacias",
    "BODEGON": "Bodegones",
    "BODEGON / LICORERIA": "Bodegones",
    "MAYORISTA CON FUERZA DE VENTA": "Mayoristas",
    "MAYORISTA SIN FUERZA DE VENTA": "Mayoristas",
    "NANO DISTRIBUIDOR": "Mayoristas",
    "SUB / DISTRIBUIDOR": "Mayoristas",
    "RESTAURANTE": "Horeca",
    "FAST FOOD": "Horeca",
    "LUNCHERIA / CAFETERIA": "Horeca",
    "HOTEL / POSADA": "Horeca",
    "CATERING / INSTITUCIONAL": "Horeca",
    "TIENDA DE CONVENIENCIA": "Tiendas de conveniencias",
    "TIENDA PARA BEBE": "Otros",
    "PIÑATERIA / TIENDA DE REGALO": "Otros",
}
#: The columns of the files.
FILES = {
    "category_dict": ["variant", "category"], "region_dict": ["variant", "region"], "cities": ["city", "region"], "phrases": ["phrase", "region"],
    "aliases": ["source", "client_code", "entity_id", "client_name", "region"],
}


def legacy(spark: SparkSession) -> DataFrame:
    """(old, new) category names."""
    return spark.createDataFrame(list(LEGACY.items()), "old string, new string")


def _file(spark: SparkSession, folder: str | None, name: str) -> DataFrame:
    """A catalog's rows with pos, their order in the file."""
    schema = ", ".join(f"{c} string" for c in FILES[name])
    path = f"{(folder or '').rstrip('/')}/{name}.csv"
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    if folder is None or not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        return spark.createDataFrame([], f"{schema}, pos long")
    rows = spark.read.csv(path, schema=schema, header=True, quote='"', escape='"', multiLine=True)  # whole: pos is the order
    return rows.withColumn("pos", F.monotonically_increasing_id())


def config(spark: SparkSession, folder: str | None = None) -> Config:
    """The configuration before anything was learned."""
    categories = spark.createDataFrame([(c, g, code, i) for i, (c, g, code) in enumerate(CATEGORIES)], "category string, category_group string, code string, pos int")
    variants = _file(spark, folder, "category_dict").join(F.broadcast(categories.drop("pos")), "category")  # CATEGORIES
    return Config(
        categories=categories.drop("code"),
        category_dict=variants.select("variant", "category", "category_group", "code", F.lit("SEED").alias("method"), F.lit(True).alias("active"), "pos"),
        regions=spark.createDataFrame([(r, i) for i, r in enumerate(REGIONS)], "region string, pos int"),
        region_dict=_file(spark, folder, "region_dict").select("variant", "region", F.lit(True).alias("active"), "pos"),
        cities=_file(spark, folder, "cities"),
        aliases=_file(spark, folder, "aliases").select("source", "client_code", "entity_id", "client_name", "region", F.lit(True).alias("active"), "pos"),
        manual=spark.createDataFrame([], "entity_id string, client_name string, category string, category_group string, region string"),
        phrases=_file(spark, folder, "phrases"),
        explicit={r: r for r in REGIONS} | OTHER_NAMES, bare=BARE_NAMES,
    )
