"""CSV to posts."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from tidewatch.operators import columns, validation
from tidewatch.operators.normalize import normalize_rows
from tidewatch.session import checkpointed, scratch_of_job
from tidewatch.sources.store import Store


@dataclass
class Checked:
    """Mapped, validated rows of a staged table, kept for the summary, the issues and the import."""

    rows: DataFrame
    mapped: DataFrame

    def summary(self) -> DataFrame:
        return validation.validation_summary(self.rows)

    def issues(self) -> DataFrame:
        return validation.row_issues(self.rows)

    def platforms(self) -> DataFrame:
        return validation.platform_distribution(self.rows)

    def missing(self) -> DataFrame:
        return validation.missing_fields(self.mapped)


def validate(staged: DataFrame, mapping: dict[str, str | None]) -> Checked:
    """Apply the mapping and flag every row. The checked rows are stored before duplicates are sought,
    so times are parsed once."""
    names = [c for c in staged.columns if c not in validation.ROW_KEY]
    columns.check_mapping(mapping, names)
    mapped = columns.apply_mapping(staged, mapping, validation.ROW_KEY)
    rows = checkpointed(validation.check_rows(mapped))
    return Checked(validation.flag_duplicates(rows), mapped)


def import_dataset(
    store: Store, staged: DataFrame, mapping: dict[str, str | None], dataset_id: str, name: str
) -> dict:
    """Validate, normalise and write a dataset; repeated, it changes nothing.

    The dataset exists from its row in `datasets` on, which is written last. An import that ends
    before leaves nothing that is ever read, and the next one replaces it.
    """
    if store.dataset(dataset_id) is not None:
        return {"imported": False}
    with scratch_of_job(store.spark):
        checked = validate(staged, mapping)
        summary = checked.summary().first().asDict()
        if not summary["valid_rows"]:
            raise ValueError("Not one row passes the checks under this mapping; nothing was imported.")
        store.import_posts(normalize_rows(checked.rows.where("is_valid"), dataset_id), dataset_id)
    if store.posts(dataset_id).count() != summary["valid_rows"]:
        raise ValueError("Fewer or more posts than valid rows were written; the dataset was not registered.")
    store.register_dataset(dataset_id, name, "imported", {"mapping": mapping, "validation": summary})
    return {"imported": True, **summary}
