"""Column functions: tagged value trees and UUIDs."""
