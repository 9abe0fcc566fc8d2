"""Operations of a training-data pipeline: language ID, tokens, packing, media, HTML, near-duplicates, quality, shards, licences, mixtures,
periodic runs, spelling variants, personal data.

Nothing else in the library imports this subpackage.
"""
