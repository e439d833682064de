"""Reading source trees and known pairs, writing outputs."""
