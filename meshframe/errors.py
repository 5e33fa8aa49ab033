"""What goes wrong with a collective call."""


class CollectiveError(Exception):
    """Any failure of a collective call."""


class InvalidArgument(CollectiveError):
    """Arguments that contradict each other or the communicator."""


class Unsupported(CollectiveError):
    """A combination of options that is not offered."""
