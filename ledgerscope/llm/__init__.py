"""Operations of a training-data pipeline over document, page and conversation tables.

Nothing else in the library imports this subpackage.
"""
