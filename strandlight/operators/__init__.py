"""DataFrame operators over recordings, frames, segments and selections."""
