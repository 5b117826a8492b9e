"""What goes wrong, by kind."""


class CodecError(ValueError):
    """Data that can't be encoded or decoded."""


class HeaderError(CodecError):
    """A record header that is not one."""


class EntropyError(CodecError):
    """A symbol stream that doesn't fit its model."""


class StrategyError(CodecError):
    """A strategy that doesn't exist or doesn't go with the type."""
