"""The whole way: pages to evidence, evidence to categories, categories to filled rows and sheets."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from ..operators.assemble import assemble_evidence
from ..operators.documents import doc_evidence, usable_images
from ..operators.match import TemplateIndex, force_category, index_templates, outcomes
from ..operators.populate import expand_variants, populate, readiness
from ..operators.publish import cell_values, sheet_cells, sheet_parts, write_failures
from ..session import cut_lineage
from ..sources.evidence import validated
from ..sources.workbooks import check_workbooks, sheet_workbooks, stored_workbooks, write_workbooks


def evidence_from_pages(pages: DataFrame, templates: DataFrame) -> DataFrame:
    """Pages to evidence, every row checked."""
    return validated(assemble_evidence(pages, templates))


def evidence_from_doc_pages(doc_pages: DataFrame, doc_images: DataFrame) -> DataFrame:
    return validated(doc_evidence(doc_pages, usable_images(doc_images)))


@dataclass
class Resolved:
    index: TemplateIndex
    outcomes: DataFrame
    population: DataFrame
    summary: DataFrame


def resolve(
    evidence: DataFrame, templates: DataFrame, fields: DataFrame, aliases: DataFrame | None = None,
    forced_template: str | None = None, variants: bool = False,
) -> Resolved:
    """Decide every record's category and fill its template.

    A forced template is a person's decision and skips detection; ``variants`` turns a multi-option field into rows.
    """
    index = index_templates(templates, fields, aliases)
    if forced_template is None:
        decided = cut_lineage(outcomes(evidence, index))
    else:
        decided = force_category(evidence.select("record_id").distinct(), forced_template)
    filled = populate(evidence, decided.filter("status = 'matched'").select("record_id", "template_id"), index)
    if variants:
        filled = expand_variants(filled)
    keys = ("record_id", "variant_no", "template_id") if variants else ("record_id", "template_id")
    return Resolved(index, decided, filled, readiness(filled, *keys))


def publish(
    population: DataFrame, templates: DataFrame, fields: DataFrame, path: str, base: str = "products"
) -> DataFrame:
    """Write sheets as whole workbooks, read them back, and return the failed parts (normally none).

    A workbook holds its template (header, sections, dropdowns, lookups, instructions) and its rows of products; both
    are compared with what was meant.
    """
    cells = cell_values(population, fields)
    parts = cut_lineage(sheet_parts(cells.select("template_id", "record_id", "variant_no").distinct(), templates, base))
    written = cut_lineage(sheet_cells(cells, parts))
    books = sheet_workbooks(written, parts, templates, fields)
    write_workbooks(*books, parts, path)
    return write_failures(check_workbooks(written, fields, parts, stored_workbooks(population.sparkSession, path, books)))
