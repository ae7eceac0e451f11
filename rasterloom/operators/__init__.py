"""DataFrame operators over images, masks, depth maps and configuration."""
