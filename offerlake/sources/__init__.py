from offerlake.sources.tables import read_table, nan_to_null, require_columns, TABLES
from offerlake.sources.offers import offers_view, OFFERS_SQL, OfferColumns, OFFER_COLUMNS

__all__ = ["read_table", "nan_to_null", "require_columns", "TABLES",
           "offers_view", "OFFERS_SQL", "OfferColumns", "OFFER_COLUMNS"]
