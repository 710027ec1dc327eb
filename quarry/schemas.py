"""The tables, one schema each, with the natural key by which rows are inserted at most once."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

_DDL = {
    "papers": ("id long, doi string, publisher string, title string, abstract string, doctype string, directory string", ["doi"]),
    "paper_corpus": ("id long, doi string, relpath string, directory string, filename string, doctype string, filebytes long, filemtime timestamp", ["relpath"]),
    "filtered_papers": ("id long, doi string, filter_name string, filter_desc string", ["doi", "filter_name"]),
    "table_cursor": ("id long, name string, `table` string, row long, comments map<string,string>", []),
    "extraction_methods": ("id long, name string, dataset string, model string, api string, para_subset string, extraction_info map<string,string>", ["name"]),
    "paper_texts": ("id long, pid long, doi string, doctype string, section string, tag string, text string, directory string", ["doi", "text"]),
    "filtered_paragraphs": ("id long, para_id long, filter_name string", ["para_id", "filter_name"]),
    "extracted_materials": (
        "id long, para_id long, method_id long, entity_name string, material_class string, polymer_type string, normalized_material_name string, "
        "coreferents array<string>, components array<string>, additional_info map<string,string>, extraction_info map<string,string>",
        ["para_id", "method_id", "entity_name"],
    ),
    "extracted_material_amounts": ("id long, para_id long, method_id long, entity_name string, material_amount string, extraction_info map<string,string>", ["method_id", "para_id", "entity_name"]),
    "extracted_properties": (
        "id long, material_id long, method_id long, entity_name string, value string, coreferents array<string>, numeric_value double, numeric_error double, "
        "value_average boolean, value_descriptor string, unit string, conditions map<string,string>, extraction_info map<string,string>, api_req long",
        ["method_id", "material_id", "entity_name", "numeric_value"],
    ),
    "rel_material_properties": ("id long, material_id long, property_id long, method_id long", ["material_id", "property_id", "method_id"]),
    "extracted_crossrefs": ("id long, para_id long, paper_id long, name string, othername string, reftype string", ["name", "reftype", "paper_id"]),
    "filtered_data": ("id long, table_name string, table_row long, filter_on string, filter_name string", ["table_name", "table_row", "filter_on", "filter_name"]),
    "extracted_data": ("id long, property_id long, method string, material string, property string, value double, unit string, doi string, confidence int", ["property_id"]),
    "property_metadata": ("id long, name string, property string, stdunit string, other_names array<string>, units array<string>, scale string, short_name string, lower_limit double, upper_limit double", ["property"]),
    "polymers": (
        "id long, name string, is_norm boolean, norm_id long, is_polymer boolean, norm_name string, iupac_name string, smiles string, is_family_name boolean, "
        "is_copolymer boolean, is_blend boolean, is_composite boolean, comments string, details map<string,string>",
        ["name"],
    ),
    "api_requests": (
        "id long, model string, api string, request string, response string, status string, details map<string,string>, para_id long, method_id long, "
        "request_obj string, response_obj string, request_tokens int, response_tokens int",
        [],
    ),
    "curated_data": ("id long, para_id long, doi string, material string, property_name string, property_value string, material_coreferents array<string>, conditions string", []),
    "paper_tables": ("id long, pid long, caption string, url string, downloaded boolean, notes string, number string, tbl_header string, tbl_index string, body string, jsonl string, descriptions array<string>", []),
}


@dataclass(frozen=True)
class Table:
    name: str
    schema: T.StructType
    key: tuple[str, ...]


def _parsed(ddl: str) -> T.StructType:
    return T.StructType.fromDDL(ddl + ", date_added timestamp")


def table(name: str) -> Table:
    """The named table's schema and natural key (empty: rows are only appended)."""
    ddl, key = _DDL[name]
    return Table(name, _parsed(ddl), tuple(key))


def names() -> list[str]:
    return list(_DDL)


def empty(spark: SparkSession, name: str) -> DataFrame:
    return spark.createDataFrame([], table(name).schema)


def create_all(spark: SparkSession, root: str) -> None:
    """Every table that isn't there yet, as empty Parquet under ``root``."""
    for name in _DDL:
        empty(spark, name).write.mode("ignore").parquet(f"{root}/{name}")
