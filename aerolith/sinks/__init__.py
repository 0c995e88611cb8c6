"""Exports of tracks, points, meshes and rasters."""
