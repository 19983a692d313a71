"""What a request can get wrong."""


class QueryError(ValueError):
    """A query, filter or limit that cannot be served as given."""


class NotFound(KeyError):
    """No record with that id."""
