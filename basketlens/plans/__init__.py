"""The registered queries; importing this package registers all of them."""

from basketlens.plans import activity, catalog, extraction, goods, ingest, ingest_runs, listing, ordered, pricing, reports, scalars, shop, text

__all__ = ["activity", "catalog", "extraction", "goods", "ingest", "ingest_runs", "listing", "ordered", "pricing", "reports", "scalars", "shop", "text"]
