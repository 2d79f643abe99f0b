"""Named queries. Importing the package registers all of them."""

from boxlake.plans import boards, folds, ingests, intake, outlooks, queries, squads, widgets  # noqa: F401
